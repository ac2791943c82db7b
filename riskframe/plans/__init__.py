"""Whole stages built from the operators, and the query catalogue."""
