"""Relational operators: compiled checks, validation, header mapping."""
