"""A record-keeping analytics engine on Spark: DataFrame operators, functions, sources and streams."""
