"""Column -> Column helpers; every one is built from Spark's own expressions."""
