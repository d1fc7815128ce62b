"""Retrieval analytics on PySpark: sources, chunking, scoring, graphs and evaluation as DataFrame operators."""
