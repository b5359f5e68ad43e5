"""Operators over documents and findings."""
