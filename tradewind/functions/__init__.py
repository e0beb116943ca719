"""Expressions shared by the plans, as Spark SQL text.

A plan is built from few large steps (``selectExpr``, ``agg`` over expression text) instead of one driver
call per operator: the text is parsed in the JVM, so building a wide plan costs milliseconds.
All expressions stay inside Spark's code generation.
"""
