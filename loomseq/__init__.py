"""loomseq: sequence analytics on Spark DataFrames."""
