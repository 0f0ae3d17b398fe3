"""skein: code and document intelligence on Spark DataFrames."""
