"""Decision trees of Spark's learners as nested tuples, column expressions and paths."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ``(feature, threshold, at most, above)`` or a prediction.
Node = tuple | float

LINE = re.compile(r"^\s*(?:(If|Else) \(feature (\d+) (<=|>) (\S+)\)|Predict: (\S+)|Tree \d+ \(weight (\S+)\):)\s*$")


def read(description: str) -> list[tuple[float, Node]]:
    """``(weight, root)`` of the trees in a model's ``toDebugString``, features all numeric."""
    lines = [m.groups() for m in map(LINE.match, description.splitlines()) if m]
    at = 0

    def node() -> Node:
        nonlocal at
        branch, feature, _, threshold, prediction, _ = lines[at]
        at += 1
        if branch is None:
            return float(prediction)
        low = node()
        at += 1  # the line of the other branch
        return int(feature), float(threshold), low, node()

    trees = []
    while at < len(lines):
        weight = float(lines[at][5])
        at += 1
        trees.append((weight, node()))
    return trees


def value(node: Node, features: Sequence[Column]) -> Column:
    """The tree's prediction for a row."""
    if isinstance(node, float):
        return F.lit(node)
    feature, threshold, low, high = node
    return F.when(features[feature] <= threshold, value(low, features)).otherwise(value(high, features))


#: Conditions ``(feature, at most?, threshold)`` that all hold.
Rule = tuple[tuple[int, bool, float], ...]


def paths(node: Node, above: Rule = ()) -> Iterator[Rule]:
    """The conditions on the way to every node below the root."""
    if above:
        yield above
    if not isinstance(node, float):
        feature, threshold, low, high = node
        yield from paths(low, (*above, (feature, True, threshold)))
        yield from paths(high, (*above, (feature, False, threshold)))


def narrowed(rule: Rule) -> Rule:
    """The same rule with one condition for each feature and direction."""
    bounds: dict[tuple[int, bool], float] = {}
    for feature, at_most, threshold in rule:
        tighter = min if at_most else max
        bounds[feature, at_most] = tighter(bounds.get((feature, at_most), threshold), threshold)
    return tuple(sorted((f, d, t) for (f, d), t in bounds.items()))


def holds(rule: Rule, features: Sequence[Column]) -> Column:
    found = F.lit(True)
    for feature, at_most, threshold in rule:
        found &= features[feature] <= threshold if at_most else features[feature] > threshold
    return found
