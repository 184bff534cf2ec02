"""Queries over the supplied tables: one or more per operator, with reference SQL."""
