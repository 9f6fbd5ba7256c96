"""spanloom: plans."""
