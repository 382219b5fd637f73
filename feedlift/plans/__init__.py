"""The registered queries, the tables they read, and their SQL."""
