"""Schemas, readers, writers and rule configuration."""
