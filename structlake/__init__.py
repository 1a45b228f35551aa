"""Spark jobs for large sets of atomic-structure records and training corpora."""
