"""Training-data operators: sharding, mixing, near-duplicates, classifiers, tokens.

Self-contained: it may import the library's general helpers, and nothing in the
library imports it.  Executors need this package on their path (``--py-files``).
"""
