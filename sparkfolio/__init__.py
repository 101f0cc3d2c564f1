"""Spark-first engine for versioned, article-structured document collections."""
