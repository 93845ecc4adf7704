"""Analytics over versioned key-value logs, written as Spark DataFrame plans."""
