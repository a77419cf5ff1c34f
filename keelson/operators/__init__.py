"""Operators on record tables as DataFrame plans."""
