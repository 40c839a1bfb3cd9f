"""Part of the library; see the README for the map of modules."""
