"""Plans of the linkage engine."""
