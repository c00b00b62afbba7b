"""Set-based analytics and table-maintenance operators for Spark DataFrames."""

__version__ = "0.1.0"
