"""Readers of landed files, row mappers and sinks."""
