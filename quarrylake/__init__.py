"""Analytics over a versioned collection of technical documents, on Spark."""
