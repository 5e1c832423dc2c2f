"""Office packages as DataFrames.

A worker opens a package and yields its raw rows; everything that is a lookup
(shared strings, styles, relationships) is a join in Spark afterwards.
"""
