"""Column helpers: identifiers, text, statistics, ranking and skew handling."""
