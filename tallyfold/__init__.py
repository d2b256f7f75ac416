"""Dataset quality and dataset lifecycle operators as plain Spark DataFrame transformations."""
