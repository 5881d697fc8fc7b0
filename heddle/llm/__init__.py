"""Training-data operators: deduplication, scanning, search, scoring, decontamination, tokenisation.

Nothing outside this subpackage imports it; it can be removed without touching the rest of the library.
"""
