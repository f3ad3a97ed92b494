"""Readers: folders, deck archives, page records, ground truth."""
