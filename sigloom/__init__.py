"""Multichannel-signal analytics on Spark DataFrames."""
