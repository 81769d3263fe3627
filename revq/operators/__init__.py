"""revq.operators."""
