"""Bindings of the given tables to the news model, query registry and oracle SQL."""
