"""Part of swathline; see the README for the map of modules."""
