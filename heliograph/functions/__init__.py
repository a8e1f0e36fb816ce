"""Column functions and time-key helpers."""
