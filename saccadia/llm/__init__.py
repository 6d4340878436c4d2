"""Operators for large text corpora: ten pipeline operators and their queries."""
