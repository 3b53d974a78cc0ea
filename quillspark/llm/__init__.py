"""Operators of a training-data pipeline on a table of documents; nothing else in the library imports them."""
