"""Declarative search, filtering, sorting and paging over Spark tables."""
