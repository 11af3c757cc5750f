"""gridmill: tabular data work (ingest, check, clean, reshape, aggregate, profile) as Spark plans.

Every operator takes DataFrames and returns DataFrames.  Statistics that an
operator needs about its own input (a mean, a bound, a total) are scalar
subqueries of the same plan, so building an operator runs no job.
"""
