"""Pairloom: business-record matching as PySpark DataFrame operators.

Every operator takes DataFrames plus plain parameters and returns a DataFrame;
the batch jobs in :mod:`pairloom.plans` chain them.
"""
