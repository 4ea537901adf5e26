"""Where source documents come from, and where tables are kept."""
