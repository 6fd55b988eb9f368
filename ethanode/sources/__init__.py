"""Readers and writers of recordings, metadata and results."""
