"""loamstone: retrieval-oriented text analytics as PySpark DataFrames."""
