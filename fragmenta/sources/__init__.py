"""Readers and writers of tables, binary records and media."""
