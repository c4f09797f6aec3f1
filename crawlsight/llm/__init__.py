"""Operators that prepare crawled text for language-model training.

Nothing outside this folder imports it; ``queries.py`` registers what it offers.
"""
