"""Corpus operators; nothing else in the library imports them."""
