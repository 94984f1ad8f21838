"""docspark: preparing, searching and analysing document collections on Spark."""
