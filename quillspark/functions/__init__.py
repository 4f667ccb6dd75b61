"""quillspark.functions."""
