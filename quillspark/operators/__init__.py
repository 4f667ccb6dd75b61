"""quillspark.operators."""
