"""corpusloom: prepare text corpora as training data with Spark DataFrames and streams."""
