"""Readers, record numbering, chunk layout and writers."""
