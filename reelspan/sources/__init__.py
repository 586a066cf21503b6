"""Sources of the manifest curation engine."""
