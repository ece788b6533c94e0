"""Lectern: document ingestion, chunking, vector retrieval and evaluation on Spark DataFrames."""
