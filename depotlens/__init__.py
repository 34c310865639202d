"""Warehouse-inventory analytics as lazy Spark DataFrames.

``tables`` everywhere in this package is a mapping from table name to DataFrame
with the columns declared in :mod:`depotlens.sources.schemas`. Build one with
:func:`depotlens.sources.reader.read_tables`, then call the jobs in
:mod:`depotlens.plans`. Every job returns a DataFrame and runs nothing by itself.
"""
