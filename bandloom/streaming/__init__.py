"""Incremental forms over streams of tiles."""
