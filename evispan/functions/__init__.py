"""Evidence-selection engine: functions."""
