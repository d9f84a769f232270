"""The same tables kept up to date from streams."""
