"""Subscriber value analytics as Spark DataFrame functions.

Every operator takes DataFrames (plus parameters) and returns a lazy DataFrame or
Column, so Catalyst sees one declarative plan from the Parquet scan to the result.
"""
