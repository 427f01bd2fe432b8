"""sessionlake: session logs of coding agents as Spark tables.

sources    read agents' files and tables into `messages` and session attributes
functions  column expressions (text, time, paths, JSON)
operators  tables to tables: assembly, filters, search, statistics, refresh
plans      registered queries over the driver's tables, with their SQL
streaming  incremental refresh with Structured Streaming
"""
