"""Report plans: functions from domain tables to one DataFrame, for all orders at once."""
