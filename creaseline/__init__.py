"""Cricket analytics expressed as Spark DataFrame transformations."""
