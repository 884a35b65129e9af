"""Column functions: text predicates, extractors, normalisers, token arrays."""
