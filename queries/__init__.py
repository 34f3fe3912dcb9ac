"""The registered queries: each runs the library on the given tables and has its SQL next to it."""
