"""Operators for preparing training text at scale, and the queries that apply them.

Nothing outside this subpackage imports it.  Each operator has a module of its own;
:mod:`treequill.llm.queries` binds them to the tables of the test data.
"""
