"""Candidate-table analytics and training-data operators on Spark DataFrames."""
