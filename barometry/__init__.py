"""Conditional session statistics, and training-data operations, as Spark jobs."""
