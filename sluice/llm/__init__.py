"""Corpus operators for training data: dedup, tokens, mixing, models, chat, secrets, HTML, quality."""
