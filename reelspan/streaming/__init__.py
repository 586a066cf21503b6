"""Streaming of the manifest curation engine."""
