"""revq.plans."""
