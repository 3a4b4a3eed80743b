"""Readers and writers of the file formats of motion capture."""
