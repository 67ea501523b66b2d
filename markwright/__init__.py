"""Batch jobs on Spark DataFrames that check, correct and account for large collections of answer sheets."""
