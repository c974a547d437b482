"""Operators of a training-data pipeline: text in, text, tokens, windows and verdicts out."""
