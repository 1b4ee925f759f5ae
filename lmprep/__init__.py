"""lmprep: preparing and scoring language-model data with Spark DataFrames."""
