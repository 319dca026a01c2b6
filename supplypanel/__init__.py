"""Analytics on yearly panels of wide supplier tables, written for Spark."""
