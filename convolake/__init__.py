"""convolake: mining large collections of assistant chat transcripts on Spark.

Every operator is a function from DataFrames to a DataFrame.  See README.md for
the map of modules and the rules about scale that they follow.
"""
