"""Adding statements month by month."""
