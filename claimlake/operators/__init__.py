"""Table functions over DataFrames."""
