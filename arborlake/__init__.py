"""Analytics over file-system inventories with Spark DataFrames."""
