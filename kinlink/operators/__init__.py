"""Operators of the linkage engine."""
