"""Independent SQL statements that the Spark plans are compared with."""
