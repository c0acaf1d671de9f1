"""Training-data operators: ten DataFrame -> DataFrame components and their queries.

Nothing else in the library imports this subpackage.
"""
