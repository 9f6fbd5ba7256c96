"""spanloom: streaming."""
