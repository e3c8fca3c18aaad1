"""Places analytics as parameterised Spark table operators."""

__version__ = "0.1.0"
