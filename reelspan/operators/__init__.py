"""Operators of the manifest curation engine."""
