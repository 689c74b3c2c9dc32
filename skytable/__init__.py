"""Deep-sky imaging tables as Spark DataFrames: frames, captures, catalogues, pixels."""
