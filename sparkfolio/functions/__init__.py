"""Column functions: visibility predicates, text, numerals, titles, tokens."""
