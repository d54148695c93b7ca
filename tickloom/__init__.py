"""Analytics of trading-strategy research on Spark: bars, indicators, simulations, statistics and selection."""
