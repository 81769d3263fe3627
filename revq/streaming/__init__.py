"""revq.streaming."""
