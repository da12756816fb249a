"""Readers, writers and generators for the brew tables."""
