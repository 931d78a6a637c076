"""quern: job-search analytics on Spark DataFrames."""
