"""Readers, writers and dataset registration."""
