"""Arithmetic on strings and on columns with Python's number semantics."""

from __future__ import annotations

import ast
import operator
import warnings

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from loomkit.functions.udfs import arrow_udf
from loomkit.schemas import ARITHMETIC

REFUSED = "Only numeric arithmetic expressions are allowed."
LARGEST_BITS = 1 << 18  # an integer power beyond this is refused, so that one row can't hold up a task


def _power(base, exponent):
    if isinstance(base, int) and isinstance(exponent, int) and exponent > 0 and abs(base).bit_length() * exponent > LARGEST_BITS:
        raise OverflowError("power is too large")
    return operator.pow(base, exponent)


APPLY = {
    ast.Add: operator.add,
    ast.Sub: operator.sub,
    ast.Mult: operator.mul,
    ast.Div: operator.truediv,
    ast.FloorDiv: operator.floordiv,
    ast.Mod: operator.mod,
    ast.Pow: _power,
    ast.UAdd: operator.pos,
    ast.USub: operator.neg,
}


def evaluate(expression: str):
    """The value of a numeric expression. Operands are taken left to right, so the first failure is the one reported.

    The tree is walked with a stack of its own: a long chain of operators needs no recursion here.
    """
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        tree = ast.parse(expression, mode="eval")
    todo: list[tuple[ast.AST, bool]] = [(tree.body, False)]
    values: list = []
    while todo:
        node, ready = todo.pop()
        if isinstance(node, ast.Constant) and isinstance(node.value, int | float):
            values.append(node.value)
        elif isinstance(node, ast.BinOp | ast.UnaryOp) and type(node.op) in APPLY:
            operands = [node.left, node.right] if isinstance(node, ast.BinOp) else [node.operand]
            if ready:
                taken = values[-len(operands) :]
                values[-len(operands) :] = [APPLY[type(node.op)](*taken)]
            else:
                todo += [(node, True), *((x, False) for x in reversed(operands))]
        else:
            raise ValueError(REFUSED)
    return values[0]


def calculated(expression: str | None) -> tuple[bool | None, str | None, float | None, str | None]:
    """(ok, value, number, display). display is the text a calculator shows; complex results and integers of more
    digits than Python prints are not ok. A null expression gives nulls."""
    if expression is None:
        return None, None, None, None
    try:
        value = evaluate(expression)
        text = str(value)
    except Exception as problem:
        return False, None, None, f"Calculation error: {problem}"
    if isinstance(value, complex):
        return False, None, None, text
    try:
        number = float(value)
    except OverflowError:
        number = None
    return True, text, number, text


@arrow_udf(ARITHMETIC)
def calculate(expressions: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([calculated(e) for e in expressions], columns=["ok", "value", "number", "display"])


def floor_div(a: Column, b: Column) -> Column:
    """a // b of integers: rounds down, where div rounds towards zero; null for a zero divisor.

    What is left after the remainder divides exactly, and decimals hold any long without rounding.
    """
    whole = (a - py_mod(a, b)).cast("decimal(20,0)")
    return F.try_divide(whole, b.cast("decimal(20,0)")).cast("long")


def py_mod(a: Column, b: Column) -> Column:
    """a % b with the divisor's sign; null for a zero divisor."""
    rest = F.try_mod(a, b)
    return F.when((rest != 0) & (F.signum(rest) != F.signum(b)), rest + b).otherwise(rest)


def py_power(a: Column, b: Column) -> Column:
    """a ** b as a double."""
    return F.power(a.cast("double"), b.cast("double"))
