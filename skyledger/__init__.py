"""skyledger: cloud observability analytics expressed as Spark DataFrame plans."""
