"""Analytics for particle snapshots, halo catalogues and merger trees on Spark."""
