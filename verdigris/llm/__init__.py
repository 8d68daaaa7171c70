"""Training-data operators: filters, deduplication, tokenisation, scoring and packing on Spark."""
