import numpy as np
import pytest

from shapecast.plans.formula import FormulaError, design, expression, learn, parse, penalty_matrix


def test_terms():
    f = parse("y ~ x + log(z) + a*b + factor(g) + pb(x, df=4, method='REML') + I(x^2) + x")
    assert [t.label for t in f.terms] == ["x", "log(z)", "a", "b", "a:b", "factor(g)", "pb(x)", "I(x^2)"]
    assert f.intercept and f.response == "y" and f.terms[6].options == {"df": 4, "method": "REML"}


@pytest.mark.parametrize("text", ["y ~ x - 1", "y ~ 0 + x", "y ~ x + 0"])
def test_no_intercept(text):
    f = parse(text)
    assert not f.intercept and [t.label for t in f.terms] == ["x"]


def test_minus_inside_a_term_stays():
    f = parse("y ~ I(x-1)")
    assert f.intercept and f.terms[0].label == "I(x-1)"


@pytest.mark.parametrize("text", ["y ~ x ~ z", "y ~ __import__('os')", "y ~ te(x)", "y ~ (x", "y ~ x + + z", "y ~ foo(x)"])
def test_errors(text):
    with pytest.raises(FormulaError):
        parse(text)


def test_design_columns(spark):
    df = spark.createDataFrame([(1.0, "b"), (2.0, "a"), (4.0, "c")], "x double, g string")
    f = parse("x ~ x + factor(g) + x:factor(g) + pb(x) + te(x, I(x*x), k=4)")
    levels, ranges = learn(df, [f])
    d = design(f, levels, ranges)
    assert levels == {"g": ["a", "b", "c"]} and ranges["x"] == (1.0, 4.0)
    got = np.array(df.select(*d.columns).collect(), float)
    assert got.shape == (3, 1 + 1 + 2 + 2 + 20 + 16)
    assert got[0, 2:4].tolist() == [1, 0] and got[1, 2:4].tolist() == [0, 0]
    assert np.allclose(got[:, 6:26].sum(axis=1), 1)  # B-splines are a partition of unity
    assert np.linalg.matrix_rank(penalty_matrix(10)) == 8
    assert expression("2 * x ** 2") is not None
