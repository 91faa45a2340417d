"""Spark-first document cleaning, enrichment and corpus analytics."""
