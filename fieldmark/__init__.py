"""fieldmark: field-level evaluation of structured predictions on Spark."""

__version__ = "0.1.0"
