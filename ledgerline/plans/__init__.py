"""Jobs that chain several operators: loading, transfers, member summaries."""
