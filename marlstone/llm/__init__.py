"""Corpus preparation for language models; nothing outside this package imports it."""
