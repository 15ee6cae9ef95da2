"""roleweave: job postings, candidate profiles and pages as Spark DataFrames."""
