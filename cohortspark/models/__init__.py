"""Regression models: each iteration is one aggregation on Spark, the small solve is on the driver."""
