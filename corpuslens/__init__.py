"""A Spark engine for document listing with frequencies: which documents hold a pattern, and how often."""
