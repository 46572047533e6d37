"""functions of the upper-air weather library."""
