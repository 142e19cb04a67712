"""Table-corpus curation and table-QA evaluation on Spark DataFrames."""
