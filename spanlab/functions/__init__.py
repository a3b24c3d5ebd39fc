"""Part of spanlab."""
