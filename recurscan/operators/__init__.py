"""DataFrame operators of the detection cascade."""
