"""Registry of methods, dry-run plans, checks."""
