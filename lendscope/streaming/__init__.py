"""Structured Streaming jobs (ST-01 .. ST-07, RSK-09, SRC-12, SRC-19)."""
