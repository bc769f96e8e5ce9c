"""A record-processing library of plain functions over Spark DataFrames and Columns."""
