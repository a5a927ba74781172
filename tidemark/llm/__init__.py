"""Operators for training corpora, one module each; nothing else in the library imports them."""
