"""Editable lookup tables, word lists and patterns used by the operators."""
