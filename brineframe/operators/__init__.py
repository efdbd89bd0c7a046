"""Operators from observation tables to observation tables."""
