"""Jobs that make one set of tables from another."""
