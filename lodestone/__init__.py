"""Grounded question answering over tables as set-at-a-time Spark DataFrames."""
