"""Whole batch jobs composed of the operators."""
