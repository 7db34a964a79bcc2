"""Operators for training corpora: documents and conversations at any size."""
