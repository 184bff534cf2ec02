"""Reading landed files and reading or publishing lakehouse tables."""
