"""The query catalogue, the SQL that says the same, and whole flows."""
