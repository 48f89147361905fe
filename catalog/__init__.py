"""Every registered query, with the SQL it is checked against."""
