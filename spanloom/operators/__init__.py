"""spanloom: operators."""
