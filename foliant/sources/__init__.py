"""Readers and writers of documents, entries and indexes."""
