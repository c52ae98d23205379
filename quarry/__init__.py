"""Corpus analytics as Spark jobs: DataFrame in, DataFrame out."""
