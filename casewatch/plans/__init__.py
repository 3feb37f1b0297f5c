"""Whole analyses composed from the operators."""
