"""Ordinaut: globally ordered sequences, tensors and maps as Spark DataFrames."""
