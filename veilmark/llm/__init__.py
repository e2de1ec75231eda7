"""Training-data operators: media columns, chat trees, near-duplicates, token
accounting, secrets, binary ids, quality, fingerprints, mixing and BPE.

Nothing outside this subpackage imports it.
"""
