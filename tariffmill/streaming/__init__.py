"""Structured Streaming twins of the landing inventory and the job log."""
