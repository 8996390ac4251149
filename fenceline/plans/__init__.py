"""Query catalogue: Spark queries with their SQL counterparts."""
