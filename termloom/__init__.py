"""Corpus and term-network analytics expressed as Spark DataFrame operators."""
