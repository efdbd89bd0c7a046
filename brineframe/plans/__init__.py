"""Whole plans: reports, pages, pipelines."""
