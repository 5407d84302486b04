"""Analytics over document corpora and conversations, as operators on Spark DataFrames."""
