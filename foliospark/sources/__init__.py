"""Readers, format detection and text extraction."""
