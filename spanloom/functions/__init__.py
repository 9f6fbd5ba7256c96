"""spanloom: functions."""
