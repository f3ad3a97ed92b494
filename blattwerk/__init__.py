"""Document extraction analytics as Spark jobs.

Functions take and return DataFrames (``operators``, ``sources``, ``plans``,
``sinks``) or Columns (``functions``); there are no wrapper objects.
"""
