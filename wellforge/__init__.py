"""wellforge: plate-image and cell-feature analytics on Spark DataFrames."""
