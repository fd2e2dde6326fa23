"""Readers and writers (CSV, Parquet, JSON records, synthetic panel, test tables)."""
