"""keelson: DataFrame-to-DataFrame operators for data-migration analytics on Spark."""
