"""corpusloom: a legal-corpus analytics engine written with Spark DataFrames."""
