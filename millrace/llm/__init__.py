"""Operators for preparing training text at scale.

Nothing outside this folder imports it. Each module holds one operator; `queries` applies them to the tables.
"""
