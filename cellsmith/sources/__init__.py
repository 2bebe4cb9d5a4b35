"""Readers, writers and table alignment."""
