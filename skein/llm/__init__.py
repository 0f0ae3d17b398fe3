"""Training-data operators: one module per operator, one thin query each.

Nothing outside this subpackage imports it.  ``registry`` holds the queries
and their SQL twins; the operators keep a general interface of their own.
"""
