"""Registered queries of the core operators, each with its SQL where SQL can express it."""

from loamgraph.queries import changes, graph, plans, references, search, texts, trends

QUERIES, ORACLES = {}, {}
for _module in (search, trends, graph, changes, texts, plans, references):
    QUERIES.update(_module.QUERIES)
    ORACLES.update(_module.ORACLES)
