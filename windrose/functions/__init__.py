"""Expressions: functions from Column to Column, and fixed values."""
