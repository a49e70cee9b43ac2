"""Readers, product normalisers, catalogues and sinks."""
