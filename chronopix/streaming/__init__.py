"""Ingest of new acquisitions as a stream. An extension: the batch engine needs none of it."""
