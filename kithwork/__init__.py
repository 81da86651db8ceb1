"""kithwork: a Spark-first engine for social-graph analytics."""
