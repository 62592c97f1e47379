"""graphloom streaming."""
