"""Datasets, parsers and sinks."""
