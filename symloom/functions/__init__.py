"""Column functions and their plain counterparts."""
