"""Brew-log analytics as Spark jobs: ingest, relational reads, features, forests, evaluation."""
