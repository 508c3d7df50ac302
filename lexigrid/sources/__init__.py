"""Readers: strings as they are, documents with headers, cached responses."""
