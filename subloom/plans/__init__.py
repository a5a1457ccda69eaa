"""End-to-end feature tables and the queries over the sample warehouse."""
