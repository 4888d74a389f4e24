"""A declarative transformation language and its incremental execution, on Spark DataFrames."""
