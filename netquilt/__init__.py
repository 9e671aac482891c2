"""netquilt: network-traffic analytics on sparse source x destination tables, Spark-first."""
