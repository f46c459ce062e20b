"""Column functions on texts and span arrays."""
