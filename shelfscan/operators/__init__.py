"""DataFrame operators: pages, products, results, requests, health, retries, logs."""
