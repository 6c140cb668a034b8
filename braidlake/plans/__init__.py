"""Queries over the operators, with the SQL they must agree with."""
