"""Ledgerline: Spark-native analytics over cross-referenced corpora."""
