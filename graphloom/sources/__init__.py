"""graphloom sources."""
