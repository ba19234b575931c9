"""A PySpark engine for content-addressed object graphs and the pointers, logs, leases and metrics around them."""
