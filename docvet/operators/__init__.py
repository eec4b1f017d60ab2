"""DataFrame-level operators: selection, collection, extraction, verification, aggregation."""
