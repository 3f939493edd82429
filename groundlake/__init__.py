"""Corpus building, retrieval and auditing as Spark DataFrame plans."""
