"""Reports: each takes a ledger and returns a DataFrame."""
