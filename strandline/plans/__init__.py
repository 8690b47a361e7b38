"""Registered queries, their SQL, and workload grids."""
