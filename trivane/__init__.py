"""Three-way decision analytics on Spark."""
