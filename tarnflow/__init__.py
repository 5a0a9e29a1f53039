"""Recommendation analytics on Spark: logs in, ranked items and ranking metrics out."""
