"""locusloom: association mapping and bulk data preparation on Spark DataFrames."""

__version__ = "0.1.0"
