"""A declarative pipeline and analytics engine on Spark DataFrames."""

__version__ = "0.1.0"
