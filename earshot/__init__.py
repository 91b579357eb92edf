"""earshot: listening analytics and recommendation jobs for Spark."""
