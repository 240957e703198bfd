"""DataFrame to DataFrame operators on line tables, record tables and the store."""
