"""Sources of the linkage engine."""
