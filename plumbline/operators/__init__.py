"""Operators: functions from DataFrames to a DataFrame, their work on the executors."""
