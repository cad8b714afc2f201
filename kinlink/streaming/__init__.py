"""Streaming of the linkage engine."""
