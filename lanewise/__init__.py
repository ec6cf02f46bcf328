"""Traffic-event analytics for fixed road cameras on Spark DataFrames."""
