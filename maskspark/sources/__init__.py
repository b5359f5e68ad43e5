"""Readers of documents, messages and scan results; writers of results."""
