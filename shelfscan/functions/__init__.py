"""Column functions: prices, texts, links."""
