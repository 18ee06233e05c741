"""Spark-native analytics over regulatory filings of financial institutions."""
