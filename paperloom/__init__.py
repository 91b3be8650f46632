"""Question-answering datasets, document retrieval and answer combination on Spark DataFrames."""
