"""Operators: functions from DataFrame to DataFrame, columns given by argument."""
