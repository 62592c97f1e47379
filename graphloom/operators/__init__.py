"""graphloom operators."""
