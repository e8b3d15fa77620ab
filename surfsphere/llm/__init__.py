"""Operators for training data: clustering, top-N, tokens, mixing and text quality."""
