import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomkit.functions import arithmetic as a


@pytest.mark.parametrize(
    ("expression", "display"),
    [
        ("1+2*3", "7"), ("7//-2", "-4"), ("-7%3", "2"), ("2**-1", "0.5"), ("1_000+0x10", "1016"), ("1e400", "inf"), ("True", "True"), ("True+1", "2"),
        ("1/0", "Calculation error: division by zero"), ("1/0 + x", "Calculation error: division by zero"),
        ("x + 1/0", f"Calculation error: {a.REFUSED}"), ("1%0", "Calculation error: integer modulo by zero"),
        ("'a'", f"Calculation error: {a.REFUSED}"), ("~1", f"Calculation error: {a.REFUSED}"), ("1 < 2", f"Calculation error: {a.REFUSED}"), ("f(1)", f"Calculation error: {a.REFUSED}"), ("1j", f"Calculation error: {a.REFUSED}"),
        ("0.0**-1", "Calculation error: 0.0 cannot be raised to a negative power"), (" 1", "Calculation error: unexpected indent (<unknown>, line 1)"), ("1 \n", "1"),
        ("2.0**5000", "Calculation error: (34, 'Numerical result out of range')"),
    ],
)
def test_display(expression, display):
    assert a.calculated(expression)[3] == display


def test_refusals():
    assert a.calculated("(-8)**0.5")[0] is False
    assert a.calculated("9**99999999")[0] is False
    assert a.calculated("10**5000")[0] is False  # more digits than Python prints
    assert a.calculated("")[0] is False
    assert a.calculated(None) == (None, None, None, None)
    assert a.calculated("+".join(["1"] * 3000))[1] == "3000" or a.calculated("+".join(["1"] * 3000))[0] is False


numbers = st.integers(-50, 50).map(str) | st.floats(-9, 9).map(lambda x: f"({x!r})")
expressions = st.recursive(numbers, lambda e: st.tuples(e, st.sampled_from(["+", "-", "*", "/", "//", "%"]), e).map(lambda t: f"({t[0]} {t[1]} {t[2]})") | e.map(lambda x: f"(-{x})"), max_leaves=12)


@given(expressions)
@settings(max_examples=200, deadline=None)
def test_equals_python(expression):
    try:
        expected = str(eval(expression))  # noqa: S307
    except Exception as problem:
        expected = f"Calculation error: {problem}"
    assert a.calculated(expression)[3] == expected


def test_columns(spark):
    pairs = [(x, y) for x in (-7, -1, 0, 7, 2**62) for y in (-3, 3, 2, 1, -1)]
    df = spark.createDataFrame(pairs, "x long, y long")
    for r in df.select("x", "y", a.floor_div(F.col("x"), F.col("y")).alias("d"), a.py_mod(F.col("x"), F.col("y")).alias("m")).collect():
        assert (r.d, r.m) == (r.x // r.y, r.x % r.y)
    zero = spark.createDataFrame([(1, 0)], "x long, y long")
    assert zero.select(a.floor_div(F.col("x"), F.col("y")), a.py_mod(F.col("x"), F.col("y"))).first() == (None, None)
