"""Jobs from read to write, and the registered queries with their SQL."""
