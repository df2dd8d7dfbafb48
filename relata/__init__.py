"""relata: a PySpark-native relational engine.

sources: catalog text, tables, stored tables and sinks. functions: predicates in conjunctive normal form and
arithmetic, as column expressions. operators: filters, projections, joins, sums, distinct, sorts. plans:
cardinality estimation, the SELECT dialect and its planner.
"""
