"""Commerce analytics jobs expressed as Spark DataFrame transformations."""
