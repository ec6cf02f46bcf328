"""Operators for training data: documents, pages and embeddings."""
