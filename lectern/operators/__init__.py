"""Relational operators over documents, chunks and vectors."""
