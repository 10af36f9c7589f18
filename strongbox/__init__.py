"""Block archives as data: plan, filter, compress, protect, hash, verify, repair."""
