"""Observation tables as streams."""
