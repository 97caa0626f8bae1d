"""corpusloom: corpus and alignment analytics expressed as Spark DataFrames."""
