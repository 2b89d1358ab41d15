"""freshet: environmental readings and hazard-area catalogues as Spark DataFrames."""
