"""Streaming extensions; recordings are otherwise complete files."""
