"""Readers and writers. Schemas are declared; nothing is inferred."""
