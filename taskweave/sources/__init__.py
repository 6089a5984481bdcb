"""Readers: files and raw records to typed rows."""
