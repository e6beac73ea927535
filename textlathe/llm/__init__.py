"""Training-data operators: each takes DataFrames and returns a DataFrame; `queries` registers them."""
