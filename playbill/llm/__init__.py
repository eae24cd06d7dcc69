"""Operators for preparing training corpora, each built on Spark jobs of its own."""
