"""Whole pipelines, and the catalog of queries over the star schema."""
