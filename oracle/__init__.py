"""The queries of the catalog as SQL for another engine: the independent check of their results."""
