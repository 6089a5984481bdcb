"""Operations analytics over review runs, deliveries and payments, on Spark.

Every operator takes DataFrames (or Columns) and returns DataFrames (or
Columns). Nothing here collects rows to the driver.
"""
