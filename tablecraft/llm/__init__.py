"""Operators for building training data: one module each, with its query and SQL.

``queries.QUERIES`` and ``queries.ORACLE`` hold what ``__spark_entry__.py`` adds. Nothing outside this
package imports it.
"""
