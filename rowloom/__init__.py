"""rowloom: run work over data on Spark.

A table of jobs is fanned out over collections, streams or file lists, an action
or a chain of steps runs on every row with errors kept as data, and the results
become receipts, write-backs, counters, progress and a final status per job.
"""
