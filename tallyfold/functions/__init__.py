"""Column expressions: text, tokens, types, identifiers, DDL text, component text."""
