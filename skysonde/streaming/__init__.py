"""Streaming jobs of the upper-air weather library."""
