"""Column builders. Each takes and returns Spark Columns; nothing here touches rows in Python."""
