"""Training-data pipeline operators.

One module per operator; :mod:`crawlq.llm.queries` registers them.  Nothing
else in the library imports this package.
"""
