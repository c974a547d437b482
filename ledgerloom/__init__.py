"""Ledger analytics for nonprofit accounting, expressed as Spark DataFrame jobs."""
