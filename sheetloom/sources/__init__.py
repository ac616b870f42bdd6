"""Readers and writers of drawing tables."""
