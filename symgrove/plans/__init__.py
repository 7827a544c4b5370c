"""Composite jobs and plan helpers built from the operators."""
