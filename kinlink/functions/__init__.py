"""Functions of the linkage engine."""
