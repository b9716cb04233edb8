"""Projections of a star schema into contract tables, so that the operators can run on it at any scale."""
