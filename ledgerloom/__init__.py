"""Ledger analytics on Spark: typed ledger tables, 256-bit arithmetic, event tables, queries and live follow."""
