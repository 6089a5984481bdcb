"""Scalar rules: functions from Column to Column, all built on Spark SQL."""
