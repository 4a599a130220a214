"""Registered queries: an operator applied to the given tables, with the SQL that it must equal."""
