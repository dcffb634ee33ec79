"""Single-cell omics analysis on Spark DataFrames: quality control to differential expression."""
