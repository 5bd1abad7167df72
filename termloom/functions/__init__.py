"""Column functions: text preparation and sequences of term ids."""
