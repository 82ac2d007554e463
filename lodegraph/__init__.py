"""lodegraph: a typed property graph, queried and ranked on Spark DataFrames."""

from lodegraph.operators.factors import DiffusedMatrixFactorization, MatrixFactorization
from lodegraph.operators.search import Default, Greedy
from lodegraph.operators.signals import Alphabetical, Connectivity, ExprStrategy, Like, PageRank
from lodegraph.plans.query import Query
from lodegraph.plans.refs import And, Attr, Compare, Condition, Degree, Edge, Engine, Expr, Has, In, Match, Node, Not, Or, Path, Ref, Score, Strategy
from lodegraph.sources.graph import EdgeTable, Graph, Key, NodeTable, Rel
from lodegraph.sources.text import from_files

#: The embedding models are imported when asked for.
_LATER = ("MODELS", "TransD", "TransE", "Translational", "load", "provenance", "train")


def __getattr__(name):
    if name in _LATER:
        from lodegraph.operators import translational

        return getattr(translational, name)
    raise AttributeError(f"module {__name__!r} has no attribute {name!r}")


__all__ = [
    *("Alphabetical", "And", "Attr", "Compare", "Condition", "Connectivity", "Default", "Degree", "DiffusedMatrixFactorization"),
    *("Edge", "EdgeTable", "Engine", "Expr", "ExprStrategy", "Graph", "Greedy", "Has", "In", "Key", "Like", "Match", "MatrixFactorization"),
    *("Node", "NodeTable", "Not", "Or", "PageRank", "Path", "Query", "Ref", "Rel", "Score", "Strategy", "from_files", *_LATER),
]
