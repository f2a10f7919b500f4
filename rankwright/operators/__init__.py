"""DataFrame operators: features, lookups, encoding, ranking and evaluation."""
