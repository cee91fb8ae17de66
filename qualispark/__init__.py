"""Process-quality analytics and statistics as lazy PySpark DataFrames."""
