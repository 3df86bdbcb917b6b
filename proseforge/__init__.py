"""proseforge: text-corpus preparation and generation evaluation on Spark DataFrames."""
