"""quillspark.streaming."""
