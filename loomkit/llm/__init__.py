"""Operators for building training data for language models; nothing outside this package imports it."""
