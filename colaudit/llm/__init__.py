"""Operators for preparing training text, kept apart from the audit engine.

Nothing outside this subpackage imports it.  Each module holds one operator with
its general interface; ``entries`` holds the thin registered queries and their SQL.
"""
