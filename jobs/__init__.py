"""Runnable jobs: ``python -m jobs.<name> --help``.

The work of each is a function that takes a session; only the command line creates
and stops one.  ``jobs.queries`` registers them as queries.
"""
