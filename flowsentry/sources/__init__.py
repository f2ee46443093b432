"""Readers, writers and the table bindings used by the query registry."""
