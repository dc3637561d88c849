"""Review analytics over semi-structured request documents, on Spark DataFrames."""
