"""Trees of a fitted forest as Spark column expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Node:
    """A split (feature <= threshold goes left) or, without feature, a leaf."""

    feature: int | None = None
    threshold: float = 0.0
    left: Node | None = None
    right: Node | None = None
    prediction: float = 0.0


def trees(model: RandomForestClassificationModel) -> list[Node]:
    """The trees of a model, read from the text in which it prints itself."""
    out = []
    for tree in model.trees:
        lines = iter([x.strip() for x in tree.toDebugString.splitlines()[1:] if x.strip()])
        out.append(_read(lines))
    return out


def _read(lines) -> Node:
    line = next(lines)
    if leaf := re.fullmatch(r"Predict: (\S+)", line):
        return Node(prediction=float(leaf[1]))
    feature, threshold = re.fullmatch(r"If \(feature (\d+) <= (\S+)\)", line).groups()
    left = _read(lines)
    next(lines)  # Else
    return Node(int(feature), float(threshold), left, _read(lines))


def paths(node: Node, so_far: tuple = ()) -> set[tuple]:
    """Every way from the root to a node, as a conjunction of (feature, is it at most, threshold)."""
    found = {so_far} if so_far else set()
    if node.feature is not None:
        found |= paths(node.left, (*so_far, (node.feature, True, node.threshold)))
        found |= paths(node.right, (*so_far, (node.feature, False, node.threshold)))
    return found


def rule(path: tuple, features: list[Column]) -> Column:
    """Whether a row keeps all conditions of a path."""
    out = F.lit(True)
    for feature, at_most, threshold in path:
        out = out & (features[feature] <= threshold if at_most else features[feature] > threshold)
    return out


def vote(node: Node, features: list[Column]) -> Column:
    """What a tree says of a row."""
    if node.feature is None:
        return F.lit(node.prediction)
    return F.when(features[node.feature] <= node.threshold, vote(node.left, features)).otherwise(vote(node.right, features))


def share_of_votes(forest: list[Node], features: list[Column]) -> Column:
    total = F.lit(0.0)
    for tree in forest:
        total = total + vote(tree, features)
    return total / len(forest)
