"""Document structure and concept graphs on Spark."""
