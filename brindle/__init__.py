"""brindle: a Spark-first analytics engine (DataFrame and SQL plans, no custom executor)."""
