"""quire: search, link and restructure libraries of documents on Spark DataFrames."""
