"""DataFrame-in, DataFrame-out operators; column names are parameters."""
