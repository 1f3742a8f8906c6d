"""The registered queries, the data they derive from the given tables, and their SQL."""
