"""lakewarden: table contracts, quality rules, recovery and incident analytics on Spark."""
