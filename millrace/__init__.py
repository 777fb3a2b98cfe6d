"""Code-corpus preparation as Spark DataFrame transformations."""
