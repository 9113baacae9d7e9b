"""Readers, file audit and writers."""
