"""Operators for text corpora: tokenizer encoding, mixing of sources, spam pages.

Nothing outside this subpackage imports it; it can be left out as a whole.
"""
