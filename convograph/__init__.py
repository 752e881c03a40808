"""convograph: analytics over group-chat logs and bitemporal fact graphs, on Spark."""
