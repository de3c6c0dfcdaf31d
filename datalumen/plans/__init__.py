"""Console, query templates, the full analysis and the query registry."""
