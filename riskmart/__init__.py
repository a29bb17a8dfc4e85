"""Payment fraud and risk analytics on Spark."""
