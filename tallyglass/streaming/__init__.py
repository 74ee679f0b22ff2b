"""Incremental forms of stored state: turns and experience arriving as streams."""
