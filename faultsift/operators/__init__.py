"""Relational operators over reports, sources, candidates and scores."""
