"""perilake: insurance lakehouse and claim-risk operators written as Spark DataFrame plans."""

__version__ = "0.1.0"
