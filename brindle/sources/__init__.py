"""Readers, writers and table-set jobs."""
