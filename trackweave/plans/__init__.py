"""Queries, their SQL twins, fixtures and whole pipelines."""
