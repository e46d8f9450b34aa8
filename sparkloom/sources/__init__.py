"""Readers of the document formats, and artifacts: staging, validation, publication."""
