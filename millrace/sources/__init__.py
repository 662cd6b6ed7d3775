"""Readers, connectors that a deployment fills in, and sinks."""
