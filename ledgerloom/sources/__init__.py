"""Statement files and period archives."""
