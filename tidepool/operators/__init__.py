"""DataFrame operators: history, pending work, variants, splits, rasters, sessions, pixels."""
