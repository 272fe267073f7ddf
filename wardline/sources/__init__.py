"""Readers and writers of extracts, reference tables, partitions and manifests."""
