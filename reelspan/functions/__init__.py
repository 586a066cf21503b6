"""Functions of the manifest curation engine."""
