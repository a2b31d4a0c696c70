"""Corpus analytics as plain DataFrame functions on Apache Spark."""
