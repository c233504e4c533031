"""terrane: a feature-collection query engine on Spark DataFrames."""

__version__ = "0.1.0"
