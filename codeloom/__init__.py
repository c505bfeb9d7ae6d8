"""codeloom: source-code graphs as Spark DataFrames."""
