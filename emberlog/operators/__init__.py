"""Operators over event, finding and indicator tables."""
