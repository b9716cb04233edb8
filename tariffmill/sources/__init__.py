"""Readers: files, canonical JSON, raw model text, vision sections and cells."""
