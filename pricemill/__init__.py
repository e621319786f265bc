"""Market-bar analytics on Spark: sources, operators, table plans, serving queries and streams."""
