"""Analytics for page-layout annotation data, as declarative Spark queries."""
