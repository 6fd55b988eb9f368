"""Operators over readings: one row per reading, ordered by idx within the episode keys."""
