"""Drift-aware preparation, rebalancing and evaluation of labelled wide tables on Spark."""
