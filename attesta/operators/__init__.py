"""DataFrame operators: joins, aggregates and windows over evidence tables."""
