"""Readers and writers of the file formats the curation work meets."""
