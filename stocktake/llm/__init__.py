"""Operators for large-scale training-data pipelines.

Nothing outside this package imports it.  Every operator takes Spark
DataFrames and returns Spark DataFrames; numpy and Arrow run only inside tasks,
on partitions that Spark made.
"""
