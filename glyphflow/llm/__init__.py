"""Training-data operators: deduplication, filtering, mixing, tokenising and scanning at corpus scale.

Nothing outside this package imports it, and the package can be removed as a whole.
"""
