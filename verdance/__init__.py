"""Urban tree-canopy analytics as ordinary Spark plans."""
