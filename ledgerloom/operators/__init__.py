"""Relational building blocks over a ledger: filters, totals, edits, de-duplication."""
