"""Registered queries: operators applied to the star-schema tables."""
