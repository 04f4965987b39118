"""waymark: bulk address matching and text-table operators on Spark DataFrames."""
