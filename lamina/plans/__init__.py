"""Statements: tokens, parsed forms, SELECT preparation."""
