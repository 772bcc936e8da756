"""Operators on event logs, as DataFrame plans."""
