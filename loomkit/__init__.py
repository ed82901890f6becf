"""loomkit: labelled-text evaluation, ensembling and corpus building on Spark DataFrames."""

__version__ = "0.1.0"
