"""Readers, writers, schemas, optional file formats and the invented study."""
