"""quillspark.sources."""
