"""Operators from DataFrame to DataFrame, lazy and without driver state."""
