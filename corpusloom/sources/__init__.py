"""Scans of captured responses and stored corpora."""
