"""Stored tables: reading them as filings, and replacing their partitions."""
