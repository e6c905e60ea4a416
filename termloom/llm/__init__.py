"""Operators of a training-data pipeline; nothing else in termloom imports this package."""
