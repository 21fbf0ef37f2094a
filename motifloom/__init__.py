"""Graph pattern matching on Spark DataFrames.

>>> from motifloom import Graph, Pattern, count
>>> count(Graph.from_edges(edges), Pattern.named("house"), induced="vertex")
"""

from motifloom.operators.graph import Graph
from motifloom.operators.match import count, enumerate_matches, match
from motifloom.plans.pattern import Pattern
from motifloom.plans.planner import make_plan

__all__ = ["Graph", "Pattern", "count", "enumerate_matches", "make_plan", "match"]
