"""The operators of a graph: what each one declares."""

from strata.operators.nodes import Fold, Node, Observer, Output, Predicate, Provider, Transform, Unfold
from strata.operators.unfolds import chunks, iota, items, steps

__all__ = ["Fold", "Node", "Observer", "Output", "Predicate", "Provider", "Transform", "Unfold", "chunks", "iota", "items", "steps"]
