"""Readers, sinks, the answer cache and the document loader."""
