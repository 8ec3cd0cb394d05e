"""Quillmill: document analytics for Spark, declared with DataFrame and SQL functions."""
