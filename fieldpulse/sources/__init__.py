"""Readers, writers and bindings from other tables."""
