"""Sequence, interval, graph and corpus analytics planned as Spark DataFrames."""
