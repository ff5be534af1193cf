"""Analytics for streams and tables of financial news, as Spark DataFrame operators."""
