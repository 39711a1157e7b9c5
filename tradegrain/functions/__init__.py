"""Column functions that pin down null, tie, rounding and time semantics."""
