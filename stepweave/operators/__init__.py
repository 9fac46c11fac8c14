"""Steps around the matcher: filters, foreach tuples, accumulators."""
