"""DataFrame-to-DataFrame operators. None of them reads or writes storage, except that the
ordering helpers cut lineage through the session's checkpoint folder."""
