"""Operators: extraction, predicates, reconciliation, similarity, comparison, aggregation, contracts."""
