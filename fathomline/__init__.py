"""Fathomline: document ingestion and vector retrieval as DataFrame plans."""
