"""Training-data operators: deduplication, decontamination, classifiers, PII, fingerprints, tokens.

Nothing outside this subpackage (and the pipeline at the repository top) imports it.
"""
