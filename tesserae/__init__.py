"""Tesserae: document analytics on Spark DataFrames."""
