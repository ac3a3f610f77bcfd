"""Corpus analytics on Spark: projection, search, contacts, mail, storage and streaming queries."""
