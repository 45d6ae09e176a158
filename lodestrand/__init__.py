"""Document and retrieval analytics expressed as lazy Spark DataFrame transformations."""

__version__ = "0.1.0"
