"""Analysis of place-distance graphs on Spark: plain DataFrame -> DataFrame operators keyed by run."""
