"""Column functions: text cleanup, instants, money and content identities."""
