"""Operators for preparing text corpora to train language models on; nothing else in the library imports them."""
