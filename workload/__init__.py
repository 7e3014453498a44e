"""The registered queries: a register view over the given tables, and one query per operator."""
