"""Reading: relations, catalogs, incremental windows and profiles."""
