"""Operators for preparing training text.

Nothing outside this package imports it.  Every operator takes and returns
DataFrames; Python kernels run under ``mapInArrow`` and never hold more than a
few megabytes of text at once, whatever the batch that Spark hands them.
"""
