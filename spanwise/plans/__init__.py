"""Composite steps: extraction, processing and reports, each a composition of operators."""
