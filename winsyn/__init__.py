"""winsyn: windowed aggregation, synopses and approximate query answering on Spark DataFrames."""
