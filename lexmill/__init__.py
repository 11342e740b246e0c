"""Vocabulary analytics on Spark: relations, facets, similarity, scores and streams as DataFrame jobs."""
