"""Plan shapes the operators share: ordered scans, exact quantiles, neighbor joins."""
