"""The whole analysis, and the queries over the driver's tables."""
