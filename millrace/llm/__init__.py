"""Operators of a training-data pipeline over crawled pages, documents and embeddings."""
