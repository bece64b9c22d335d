"""Readers of corpora, recordings and earlier runs."""
