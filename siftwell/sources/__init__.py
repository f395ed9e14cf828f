"""Datasets, declared constraints and samples."""
