"""Operators of a training-data pipeline: duplicates, quality, mixing, secrets, chat formatting, tokens."""
