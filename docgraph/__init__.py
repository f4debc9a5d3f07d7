"""Linked-document analytics on Spark DataFrames."""
