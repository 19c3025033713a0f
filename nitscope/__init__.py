"""nitscope: HDR and dynamic-metadata analytics, built on Spark DataFrames."""

__version__ = "0.1.0"
