"""Part of termloom: functions."""
