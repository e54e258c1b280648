"""Readers, canonical views and sinks."""
