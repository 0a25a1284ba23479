"""Composed workloads and the registered queries with their SQL checks."""
