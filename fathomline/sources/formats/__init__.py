"""Parsers of file formats. Each takes bytes and gives a document: full_text, pages and assets."""
