"""Recurring-pattern detection on Spark: functions that look like an unpatched copy of a known vulnerable one."""
