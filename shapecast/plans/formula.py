"""Formulas: text to terms, and terms to Columns.

`y ~ x + log(z) + a:b + a*b + factor(g) + pb(x, df=5) + te(x1, x2) - 1`. Terms learn what they need from the data (factor
levels, ranges) in one aggregation; their design columns are built-in expressions, so predicting a model is a `select`.
"""

from __future__ import annotations

import ast
import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Levels of a factor, of which each but one is a column.
MOST_LEVELS = 10_000
SMOOTHERS = ("pb", "ps", "cs", "s", "te", "ti", "tps")


class FormulaError(ValueError):
    """A formula that can't be read, or that asks for something unknown."""


@dataclass(frozen=True)
class Term:
    """kind: linear (expression), factor, interaction or a smoother's name. args: variables or expressions; options: of smoothers."""

    kind: str
    args: tuple[str, ...]
    options: dict = field(default_factory=dict, hash=False)

    @property
    def label(self) -> str:
        if self.kind == "linear":
            return self.args[0]
        if self.kind == "interaction":
            return ":".join(self.args)
        return f"{self.kind}({', '.join(self.args)})"


@dataclass(frozen=True)
class Formula:
    response: str | None
    terms: tuple[Term, ...]
    intercept: bool

    @property
    def smooth(self) -> bool:
        return any(t.kind in SMOOTHERS for t in self.terms)

    @property
    def intercept_only(self) -> bool:
        return self.intercept and not self.terms

    def variables(self) -> list[str]:
        found = []
        for t in self.terms:
            for a in t.args:
                found += [n.id for n in ast.walk(_tree(a)) if isinstance(n, ast.Name) and n.id not in FUNCTIONS]
        return list(dict.fromkeys(found))

    def text(self) -> str:
        parts = [t.label for t in self.terms] or ["1"]
        return f"{self.response or ''} ~ {' + '.join(parts)}{'' if self.intercept else ' - 1'}".strip()


def split_top(text: str, seps: str) -> list[tuple[str, str]]:
    """(separator before, piece) at separators outside brackets and quotes."""
    out, depth, quote, sign, start = [], 0, "", "+", 0
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"`":
            quote = c
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
            if depth < 0:
                raise FormulaError(f"unbalanced brackets in {text!r}")
        elif depth == 0 and c in seps and not (c == "-" and re.search(r"[*/^]\s*$|\d[eE]$", text[start:i])):
            if text[start:i].strip() or out:
                out.append((sign, text[start:i].strip()))
            sign, start = c, i + 1
    if depth or quote:
        raise FormulaError(f"unbalanced brackets or quotes in {text!r}")
    out.append((sign, text[start:].strip()))
    return out


FUNCTIONS = {"abs": F.abs, "cos": F.cos, "exp": F.exp, "I": lambda c: c, "log": F.log, "sin": F.sin, "sqrt": F.sqrt, "log10": F.log10, "log1p": F.log1p}


def _tree(text: str) -> ast.AST:
    try:
        return ast.parse(text.replace("^", "**"), mode="eval").body
    except SyntaxError as e:
        raise FormulaError(f"can't read {text!r}") from e


def expression(text: str, depth: int = 16) -> Column:
    """A term's expression: + - * / ** and a fixed list of functions over columns."""

    def build(n: ast.AST, left: int) -> Column:
        if left == 0:
            raise FormulaError(f"{text!r} is nested too deeply")
        if isinstance(n, ast.Name):
            return F.col(f"`{n.id}`").cast("double")
        if isinstance(n, ast.Constant) and isinstance(n.value, (int, float)):
            return F.lit(float(n.value))
        if isinstance(n, ast.UnaryOp) and isinstance(n.op, (ast.USub, ast.UAdd)):
            x = build(n.operand, left - 1)
            return -x if isinstance(n.op, ast.USub) else x
        if isinstance(n, ast.BinOp):
            a, b = build(n.left, left - 1), build(n.right, left - 1)
            for kind, f in ((ast.Add, lambda: a + b), (ast.Sub, lambda: a - b), (ast.Mult, lambda: a * b), (ast.Div, lambda: a / b), (ast.Pow, lambda: F.pow(a, b))):
                if isinstance(n.op, kind):
                    return f()
        if isinstance(n, ast.Call) and isinstance(n.func, ast.Name) and n.func.id in FUNCTIONS and len(n.args) == 1 and not n.keywords:
            return FUNCTIONS[n.func.id](build(n.args[0], left - 1))
        raise FormulaError(f"{ast.dump(n)[:60]} isn't allowed in {text!r}")

    return build(_tree(text), depth)


def _option(text: str):
    try:
        return ast.literal_eval(text)
    except (ValueError, SyntaxError):
        return text


def _term(text: str) -> Term:
    m = re.fullmatch(r"(\w+)\s*\((.*)\)", text, re.S)
    if m and m[1] in (*SMOOTHERS, "factor"):
        args, options = [], {}
        for _, piece in split_top(m[2], ","):
            k = re.fullmatch(r"(\w+)\s*=\s*(.+)", piece, re.S)
            if k:
                options[k[1]] = _option(k[2])
            elif piece:
                args.append(piece)
        if not args or m[1] in ("te", "ti") and len(args) < 2:
            raise FormulaError(f"{text!r} needs {'two variables' if m[1] in ('te', 'ti') else 'a variable'}")
        if m[1] == "factor":
            return Term("factor", (args[0],))
        kind = {"s": options.pop("smoother", "pb")}.get(m[1], m[1])
        return Term(kind, tuple(args), options)
    parts = [p for _, p in split_top(text, ":")]
    if len(parts) > 1:
        return Term("interaction", tuple(parts))
    expression(text)
    return Term("linear", (text,))


def parse(text: str) -> Formula:
    """y ~ terms. `-1`, `0 +` and `+ 0` drop the intercept; a*b is a + b + a:b; repeated terms count once."""
    sides = text.split("~")
    if len(sides) > 2:
        raise FormulaError(f"more than one ~ in {text!r}")
    response = (sides[0].strip() or None) if len(sides) == 2 else None
    intercept, terms = True, []
    for sign, piece in split_top(sides[-1].strip(), "+-"):
        if piece in ("0", "1"):
            intercept = (piece == "1") == (sign == "+")
        elif not piece:
            raise FormulaError(f"an empty term in {text!r}")
        elif sign == "-":
            terms = [t for t in terms if t.label != _term(piece).label]
        else:
            parts = [p for _, p in split_top(piece, "*")]
            crossed = len(parts) > 1 and all(re.fullmatch(r"\w+|factor\(\w+\)", p) and not re.fullmatch(r"\d+", p) for p in parts)
            for t in [*map(_term, parts), *([Term("interaction", tuple(parts))] if len(parts) == 2 else [])] if crossed else [_term(piece)]:
                if t.label not in [x.label for x in terms]:
                    terms.append(t)
    return Formula(response, tuple(terms), intercept)


# --- bases --------------------------------------------------------------------------------------------------------------


def difference_penalty(n: int, order: int = 2) -> np.ndarray:
    """D of the given order."""
    return np.diff(np.eye(n), n=order, axis=0)


def penalty_matrix(n: int, order: int = 2) -> np.ndarray:
    d = difference_penalty(n, order)
    return d.T @ d


def cubic_bspline(x: Column, centre: float, h: float) -> Column:
    """The cubic B-spline on equally spaced knots, centred, as a Column."""
    u = F.abs(x - F.lit(centre)) / F.lit(h)
    return F.when(u < 1, (4 - 6 * u * u + 3 * u * u * u) / 6).when(u < 2, F.pow(2 - u, F.lit(3.0)) / 6).otherwise(0.0)


@dataclass
class Block:
    """One term's part of a design: column names and expressions, and penalties on its coefficients."""

    label: str
    kind: str
    names: list[str]
    columns: list[Column]
    penalties: list[np.ndarray] = field(default_factory=list)
    options: dict = field(default_factory=dict)
    centred: bool = False


def _marginal(name: str, low: float, high: float, k: int) -> tuple[list[Column], np.ndarray]:
    h = (high - low) / max(k - 3, 1) or 1.0
    x = expression(name)
    return [cubic_bspline(x, low + h * (j - 1), h) for j in range(k)], penalty_matrix(k)


def _spline(term: Term, info: dict) -> Block:
    low, high = info[term.args[0]]
    k = int(term.options.get("inter", 20 if term.kind == "ps" else 17)) + 3
    cols, pen = _marginal(term.args[0], low, high, k)
    return Block(term.label, term.kind, [f"{term.label}_{j + 1}" for j in range(k)], cols, [pen], term.options)


def _natural_cubic(term: Term, info: dict) -> Block:
    """Natural cubic regression spline by truncated powers, penalised by the integral of its squared second derivative."""
    low, high = info[term.args[0]]
    k = int(term.options.get("k", 10))
    x, knots = expression(term.args[0]), np.linspace(low, high, k)
    scale = (high - low) or 1.0

    def cube(t):
        u = (x - F.lit(float(t))) / scale
        return F.when(u > 0, u * u * u).otherwise(0.0)

    def d(j):
        return (cube(knots[j]) - cube(knots[-1])) / ((knots[-1] - knots[j]) / scale)

    cols = [(x - F.lit(low)) / scale] + [d(j) - d(k - 2) for j in range(k - 2)]
    # second derivatives are linear between knots: two Gauss points in each interval are exact
    s = (knots - low) / scale
    mid, half = (s[1:] + s[:-1]) / 2, (s[1:] - s[:-1]) / 2
    at = np.concatenate([mid - half / np.sqrt(3), mid + half / np.sqrt(3)])
    second = lambda j: (np.maximum(at - s[j], 0) - np.maximum(at - s[-1], 0)) * 6 / (s[-1] - s[j])
    b = np.stack([np.zeros(len(at))] + [second(j) - second(k - 2) for j in range(k - 2)], axis=1)
    pen = (b * np.concatenate([half, half])[:, None]).T @ b
    return Block(term.label, "cs", [f"{term.label}_{j + 1}" for j in range(k - 1)], cols, [pen], term.options)


def null_space(a: np.ndarray) -> np.ndarray:
    """Orthonormal columns z with a z = 0."""
    return np.linalg.svd(a)[2][np.linalg.matrix_rank(a) :].T


def spline_means(k: int) -> np.ndarray:
    """Means over the range of the k cubic B-splines on equally spaced knots."""
    x = (np.arange(4000) + 0.5) / 4000 * (k - 3)
    u = np.abs(x[:, None] - (np.arange(k) - 1))
    return np.where(u < 1, (4 - 6 * u**2 + 3 * u**3) / 6, np.where(u < 2, (2 - np.minimum(u, 2)) ** 3 / 6, 0)).mean(axis=0)


def _tensor(term: Term, info: dict) -> Block:
    opts = term.options
    ks = opts.get("k_list") or [int(opts.get("k", 5))] * len(term.args)
    cols, pens = None, []
    for v, k in zip(term.args, ks, strict=True):
        low, high = info[v]
        pad = 0.01 * (high - low)
        more, pen = _marginal(v, low - pad, high + pad, int(k))
        if term.kind == "ti":  # combinations whose mean over the range is 0, so that main effects are no part of the product
            z = null_space(spline_means(int(k))[None])
            more = [sum((F.lit(float(z[i, j])) * c for i, c in enumerate(more)), F.lit(0.0)) for j in range(z.shape[1])]
            pen = z.T @ pen @ z
        pens = [np.kron(p, np.eye(len(more))) for p in pens] + [np.kron(np.eye(len(cols or [1])), pen)]
        cols = [a * b for a in cols for b in more] if cols else more
    return Block(term.label, term.kind, [f"{term.label}_{j + 1}" for j in range(len(cols))], cols, pens, opts)


def _thin_plate(term: Term, info: dict) -> Block:
    """Radial functions on a grid of knots: r^3 in one dimension, r^2 log r in two, -r in three; of their combinations those that no linear function is part of, penalised by the bending energy."""
    dims, k = len(term.args), int(term.options.get("k", 10 if len(term.args) == 1 else 16))
    side = max(2, round(k ** (1 / dims)))
    axes = [np.linspace(*info[v], side) for v in term.args]
    scales = [(info[v][1] - info[v][0]) or 1.0 for v in term.args]
    knots = np.stack([g.ravel() for g in np.meshgrid(*axes)], axis=1)

    def radial(r2):
        r = F.sqrt(r2)
        return r2 * r if dims == 1 else F.when(r2 > 0, 0.5 * r2 * F.log(r2)).otherwise(0.0) if dims == 2 else -r

    xs = [expression(v) for v in term.args]
    cols = [(x - F.lit(float(info[v][0]))) / s for x, v, s in zip(xs, term.args, scales, strict=True)]
    near = [radial(sum(((x - F.lit(float(c))) / s) * ((x - F.lit(float(c))) / s) for x, c, s in zip(xs, t, scales, strict=True))) for t in knots]
    z = knots / np.array(scales)
    r2 = ((z[:, None] - z[None]) ** 2).sum(-1)
    e = r2**1.5 if dims == 1 else np.where(r2 > 0, 0.5 * r2 * np.log(np.where(r2 > 0, r2, 1)), 0) if dims == 2 else -np.sqrt(r2)
    free = null_space(np.concatenate([np.ones((1, len(z))), (z - z.mean(axis=0)).T]))
    cols += [sum((F.lit(float(free[i, j])) * c for i, c in enumerate(near)), F.lit(0.0)) for j in range(free.shape[1])]
    pen = np.zeros((len(cols),) * 2)
    pen[dims:, dims:] = free.T @ e @ free
    return Block(term.label, "tps", [f"{term.label}_{j + 1}" for j in range(len(cols))], cols, [pen], term.options)


@dataclass
class Design:
    """The columns of one parameter's predictor, fixed at fit time."""

    formula: Formula
    blocks: list[Block]
    levels: dict[str, list]
    ranges: dict[str, tuple[float, float]]

    @property
    def names(self) -> list[str]:
        return [n for b in self.blocks for n in b.names]

    @property
    def columns(self) -> list[Column]:
        return [c for b in self.blocks for c in b.columns]

    def slices(self) -> list[slice]:
        ends = np.cumsum([0, *(len(b.names) for b in self.blocks)])
        return [slice(int(a), int(b)) for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def schema(self) -> dict:
        return {"formula": self.formula.text(), "levels": self.levels, "ranges": {k: list(v) for k, v in self.ranges.items()}, "columns": self.names}


def learn(df: DataFrame, formulas: list[Formula]) -> tuple[dict, dict]:
    """(levels of factors, ranges of smooth variables) in one aggregation. Levels are sorted; null is no level."""
    named = [(t, a) for f in formulas for t in f.terms for a in t.args]
    factors = {a for t, a in named if t.kind == "factor"}
    factors |= {m[1] for t, a in named if t.kind == "interaction" and (m := re.fullmatch(r"factor\((\w+)\)", a))}
    smooth = {a for f in formulas for t in f.terms if t.kind in SMOOTHERS for a in t.args}
    if factors:
        sizes = df.agg(*[F.approx_count_distinct(F.col(g).cast("string")).alias(g) for g in sorted(factors)]).first()
        for g in sorted(factors):
            if sizes[g] > MOST_LEVELS:
                raise FormulaError(f"factor({g}) has about {sizes[g]} levels; {MOST_LEVELS} at most")
    wanted = [F.array_sort(F.collect_set(F.col(g).cast("string"))).alias(f"l_{g}") for g in sorted(factors)]
    wanted += [x for v in sorted(smooth) for x in (F.min(expression(v)).alias(f"lo_{v}"), F.max(expression(v)).alias(f"hi_{v}"))]
    if not wanted:
        return {}, {}
    row = df.agg(*wanted).first()
    return {g: row[f"l_{g}"] for g in sorted(factors)}, {v: (float(row[f"lo_{v}"]), float(row[f"hi_{v}"])) for v in sorted(smooth)}


def _pieces(text: str, levels: dict) -> list[tuple[str, Column]]:
    m = re.fullmatch(r"factor\((\w+)\)", text)
    if not m:
        return [(text, expression(text))]
    g = F.col(m[1]).cast("string")
    seen = levels[m[1]]
    unseen = F.concat(F.lit(f"unseen_level: {m[1]} has a level that the fit didn't see: "), g)
    cols = [(f"{text}{v}", (g == F.lit(v)).cast("double")) for v in seen[1:]]
    # the first column checks; a null level stays null
    return [(n, F.when(g.isin(seen), c).when(g.isNotNull(), F.raise_error(unseen).cast("double")) if i == 0 else c) for i, (n, c) in enumerate(cols)]


def design(formula: Formula, levels: dict, ranges: dict) -> Design:
    blocks = [Block("(Intercept)", "intercept", ["(Intercept)"], [F.lit(1.0)])] if formula.intercept else []
    for t in formula.terms:
        if t.kind == "linear":
            blocks.append(Block(t.label, "linear", [t.label], [expression(t.args[0])]))
        elif t.kind == "factor":
            names, cols = zip(*_pieces(t.label, levels), strict=True) if len(levels[t.args[0]]) > 1 else ((), ())
            blocks.append(Block(t.label, "factor", list(names), list(cols)))
        elif t.kind == "interaction":
            parts = [("", F.lit(1.0))]
            for a in t.args:
                parts = [(f"{n}:{m}" if n else m, c * d) for n, c in parts for m, d in _pieces(a, levels)]
            blocks.append(Block(t.label, "interaction", [n for n, _ in parts], [c for _, c in parts]))
        elif t.kind in ("pb", "ps"):
            blocks.append(_spline(t, ranges))
        elif t.kind == "cs":
            blocks.append(_natural_cubic(t, ranges))
        elif t.kind in ("te", "ti"):
            blocks.append(_tensor(t, ranges))
        elif t.kind == "tps":
            blocks.append(_thin_plate(t, ranges))
        else:
            raise FormulaError(f"unknown term {t.label!r}")
    return Design(formula, blocks, levels, ranges)


def parameter_formulas(main: str, parameters: tuple[str, ...], given: dict[str, str | None]) -> dict[str, Formula]:
    """A formula per parameter: the main one for the first, `~ 1` where none is given."""
    first = parse(main)
    unknown = [p for p, v in given.items() if v is not None and p not in parameters]
    if unknown:
        raise FormulaError(f"no such parameter: {', '.join(unknown)}; the family has {', '.join(parameters)}")
    out = {parameters[0]: first}
    for p in parameters[1:]:
        out[p] = parse(given.get(p) or "~ 1")
    return out


__all__ = ["Block", "Design", "Formula", "FormulaError", "Term", "design", "difference_penalty", "expression", "learn", "parameter_formulas", "parse", "penalty_matrix"]
