"""Signal analytics and sequence decoding on PySpark DataFrames."""
