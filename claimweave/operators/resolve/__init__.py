"""Resolvers: references to relations, by joins."""
