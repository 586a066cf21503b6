"""reelspan: media-manifest curation analytics on PySpark DataFrames."""
