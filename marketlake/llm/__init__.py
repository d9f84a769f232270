"""Operators for large-scale training data: pairs, searches, tokenizers, packing, classifiers."""
