"""Query plans: the registered queries (Spark side) and their SQL oracles."""
