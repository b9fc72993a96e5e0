"""litquarry: literature-to-dataset analytics expressed as Spark DataFrame jobs."""
