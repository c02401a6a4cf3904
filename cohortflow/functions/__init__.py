"""Column expressions: clock arithmetic, predicates, strict aggregates, categories."""
