"""Detection rules and their translation to columns."""
