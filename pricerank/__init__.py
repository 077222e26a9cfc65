"""Spark-native price survey analytics: latest prices, basket costing and store ranking over many baskets at once."""
