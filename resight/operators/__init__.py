"""Operators: functions from DataFrames to DataFrames, with column roles as parameters."""
