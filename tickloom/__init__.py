"""tickloom: market-by-order analytics expressed as Spark DataFrame jobs."""
