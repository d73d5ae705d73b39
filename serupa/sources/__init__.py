"""Readers and writers of the file forms in use."""
