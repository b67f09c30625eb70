"""Reading logs and keeping summaries."""
