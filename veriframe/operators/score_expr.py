"""Arithmetic on score keys, checked against a list of what is allowed and turned into columns."""

from __future__ import annotations

import ast
import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

BINARY = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv}
AXES = ("p_faith", "p_rel")


def compile_expression(text: str, scores: str = "scores") -> Column:
    """A column for + - * / ( ), signs, numbers and dotted keys; anything else is a ValueError.

    A key that a row lacks and a division by zero are errors when the row is read."""

    def key(node: ast.expr) -> str:
        if isinstance(node, ast.Name):
            return node.id
        if isinstance(node, ast.Attribute):
            return f"{key(node.value)}.{node.attr}"
        raise ValueError(f"not a score key in {text!r}")

    def build(node: ast.expr) -> Column:
        if isinstance(node, ast.Constant) and type(node.value) in (int, float):
            return F.lit(float(node.value))
        if isinstance(node, ast.Attribute):
            name = key(node)
            found = F.try_element_at(F.col(scores), F.lit(name))
            return F.coalesce(found, F.raise_error(F.lit(f"no score {name}")).cast("double"))
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.USub, ast.UAdd)):
            inner = build(node.operand)
            return -inner if isinstance(node.op, ast.USub) else inner
        if isinstance(node, ast.BinOp) and type(node.op) in BINARY:
            left, right = build(node.left), build(node.right)
            if isinstance(node.op, ast.Div):
                right = F.when(right == 0, F.raise_error(F.lit("division by zero in a score expression")).cast("double")).otherwise(right)
            return BINARY[type(node.op)](left, right)
        raise ValueError(f"{type(node).__name__} is not allowed in {text!r}")

    try:
        tree = ast.parse(text.strip(), mode="eval")
    except SyntaxError as wrong:
        raise ValueError(f"{text!r} is no expression") from wrong
    return build(tree.body)


def axis_prefix(scores: Column) -> Column:
    """The one prefix that has both axes; none or several is an error."""
    names = F.array_distinct(F.transform(F.map_keys(scores), lambda k: F.substring_index(k, ".", 1)))
    both = F.filter(names, lambda p: F.forall(F.array(*[F.lit(a) for a in AXES]), lambda a: F.array_contains(F.map_keys(scores), F.concat(p, F.lit("."), a))))
    return F.when(F.size(both) == 1, F.get(both, F.lit(0))).otherwise(F.raise_error(F.concat(F.lit("prefixes with both axes: "), F.array_join(both, ","))).cast("string"))


def default_score(scores: Column, axis: str | None = None) -> Column:
    """p_faith * p_rel of the only prefix that has both, or one axis of it."""
    p = axis_prefix(scores)
    value = lambda a: F.try_element_at(scores, F.concat(p, F.lit(f".{a}")))
    return value(axis) if axis else value("p_faith") * value("p_rel")
