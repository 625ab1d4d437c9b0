"""Schemas of the tables that operators take and give."""

ARCS = "src long, dst long, w double"
EDGES = "u long, v long, w double"
