"""Similarity analytics over vectors, images and text on Spark DataFrames."""
