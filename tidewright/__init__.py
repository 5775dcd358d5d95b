"""Order-dependency profiling and maintenance expressed as Spark plans."""
