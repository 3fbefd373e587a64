"""Document-table analytics expressed as Spark DataFrame plans.

Sub-packages
------------
functions   column expressions (text, numbers, geometry, markup)
operators   DataFrame -> DataFrame transforms
sources     readers and writers
plans       composite analytics built from operators
streaming   incremental variants over Structured Streaming
"""
