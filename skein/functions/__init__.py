"""Column functions: JSON-encoded property values, and templates compiled to columns."""
