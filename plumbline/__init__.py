"""plumbline: explainable analytics on Spark DataFrames."""
