"""Analytics over two-sided match results as Spark plans."""
