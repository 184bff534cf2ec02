"""Contracts with their fixed values, and the end-to-end runs built from the operators."""
