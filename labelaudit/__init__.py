"""Label-compliance analytics on PySpark DataFrames."""
