"""Reading, writing and registering tables, and the adapter for the retail test tables."""
