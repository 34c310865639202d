"""Reusable table-to-table operators."""
