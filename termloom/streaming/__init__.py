"""Continuous word counts."""
