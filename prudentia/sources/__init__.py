"""Readers: published files, stored tables and the line-item adapter."""
