"""Readers and writers around the Spark data source API."""
