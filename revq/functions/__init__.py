"""revq.functions."""
