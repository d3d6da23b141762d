"""Readers, table bindings and sinks."""
