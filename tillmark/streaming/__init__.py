"""The sales metrics over streams."""
