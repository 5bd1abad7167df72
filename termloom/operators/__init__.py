"""Operators on words, encoded collections and n-gram relations."""
