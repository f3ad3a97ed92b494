"""Whole runs, one function per command."""
