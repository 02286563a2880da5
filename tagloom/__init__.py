"""Curation of semi-structured, free-text sample metadata on Spark.

Every operator takes DataFrames and column names and gives a DataFrame back; nothing runs until
the caller asks for rows, except where a docstring says that a bounded look at the data comes
first (size checks before a broadcast, fitting a model).
"""

__version__ = "0.1.0"
