"""Readers and writers: CSV, JSON and Parquet in, JSON and CSV out."""
