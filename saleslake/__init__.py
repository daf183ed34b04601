"""Sales analytics on PySpark: staged daily loads, a star schema, quality gates, reports and a windowed stream."""
