"""Readers and writers of record texts and datasets."""
