"""Corpus preparation: ten operators for training data, their queries and SQL."""
