"""Typed readers and writers of audit tables."""
