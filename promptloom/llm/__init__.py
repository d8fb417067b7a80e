"""Training-data operators over document tables (text, source, language).

Every module holds one operator with its own interface; ``queries`` applies
them to the provided tables.  Nothing else in the package imports this one.
"""
