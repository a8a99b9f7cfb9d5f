"""Extractors: sources to rows."""
