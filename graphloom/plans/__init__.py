"""graphloom plans."""
