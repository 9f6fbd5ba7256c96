"""spanloom: sources."""
