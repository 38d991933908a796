"""Analytics over large collections of incident reports, expressed as Spark DataFrame jobs."""
