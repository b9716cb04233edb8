"""Export projections and writers."""
