"""The reports: each function maps tables and parameters to a lazy DataFrame."""
