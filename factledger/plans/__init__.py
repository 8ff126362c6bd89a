"""Analytics jobs: each takes and returns DataFrames."""
