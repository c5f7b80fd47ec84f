"""Scalar functions: Column in, Column out, inside the JVM unless a module says otherwise."""
