"""revq.sources."""
