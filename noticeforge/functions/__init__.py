"""Part of the announcement engine."""
