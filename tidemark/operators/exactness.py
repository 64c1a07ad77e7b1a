"""Exact numbers on columns: formulas in decimals of fifty digits and in rationals, decimals that terminate, exact ranks.

Amounts are texts, as no column type holds them. The work is done in Arrow batches; a formula is parsed once per process.
"""

from __future__ import annotations

import ast
from decimal import Clamped, Context, Decimal, DecimalException, DivisionByZero, InvalidOperation, Overflow
from decimal import ROUND_HALF_EVEN
from fractions import Fraction
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.exact import fits_96_bits, single_entry_nav, terminating
from tidemark.operators.formula import FormulaError, names, parse

LEAST, MOST, MOST_OPERATIONS = Decimal("1e-100"), Decimal("1e100"), 512
_FIFTY = Context(prec=50, rounding=ROUND_HALF_EVEN, traps=[DivisionByZero, InvalidOperation, Overflow, Clamped])


class _Refused(Exception):
    pass


class _Decimals:
    """Fifty digits, half to even; a value that is not zero must lie within LEAST..MOST in size."""

    def __init__(self) -> None:
        self.count = 0

    def number(self, text: object) -> Decimal:
        return self.bounded(_FIFTY.create_decimal(str(text)))

    def bounded(self, value: Decimal) -> Decimal:
        if value and not LEAST <= abs(value) <= MOST:
            raise _Refused("magnitude")
        return value

    def apply(self, op: ast.operator, a: Decimal, b: Decimal) -> Decimal:
        self.count += 1
        if self.count > MOST_OPERATIONS:
            raise _Refused("operations")
        if isinstance(op, ast.Div) and not b:
            raise _Refused("zero_denominator")
        work = {ast.Add: _FIFTY.add, ast.Sub: _FIFTY.subtract, ast.Mult: _FIFTY.multiply, ast.Div: _FIFTY.divide}[type(op)]
        return self.bounded(work(a, b))

    def show(self, value: Decimal) -> str:
        return format(value.normalize(_FIFTY) if value else Decimal(0), "f")


class _Rationals(_Decimals):
    """Without any rounding; the second way to the same value."""

    def number(self, text: object) -> Fraction:
        return Fraction(str(text))

    def apply(self, op: ast.operator, a: Fraction, b: Fraction) -> Fraction:
        if isinstance(op, ast.Div):
            if not b:
                raise _Refused("zero_denominator")
            return a / b
        return a + b if isinstance(op, ast.Add) else a - b if isinstance(op, ast.Sub) else a * b

    def show(self, value: Fraction) -> str:
        return f"{value.numerator}/{value.denominator}"


_parsed = lru_cache(maxsize=256)(parse)


def evaluate(text: str, values: dict[str, object], exact: bool = False) -> tuple[str | None, str | None]:
    """(value, reason) of a formula over decimal texts, and lists of them for delta and compound_return: reason is missing,
    zero_denominator, magnitude, operations, too_short or number, and then there is no value."""
    kind = _Rationals() if exact else _Decimals()

    def of(node: ast.AST):
        match node:
            case ast.BinOp():
                return kind.apply(node.op, of(node.left), of(node.right))
            case ast.UnaryOp():
                inner = of(node.operand)
                return -inner if isinstance(node.op, ast.USub) else inner
            case ast.Constant():
                return kind.number(ast.get_source_segment(text, node))
            case ast.Name():
                return kind.number(present(values.get(node.id)))
        series = [kind.number(present(v)) for v in present(values.get(node.args[0].id))]
        if node.func.id == "delta":
            if len(series) != 2:
                raise _Refused("too_short")
            return kind.apply(ast.Sub(), series[1], series[0])
        n = node.args[1].value
        if len(series) < n:
            raise _Refused("too_short")
        one = kind.number(1)
        product = one
        for r in series[-n:]:
            product = kind.apply(ast.Mult(), product, kind.apply(ast.Add(), one, r))
        return kind.apply(ast.Sub(), product, one)

    def present(value: object) -> object:
        if value is None:
            raise _Refused("missing")
        return value

    try:
        return kind.show(of(_parsed(text))), None
    except _Refused as e:
        return None, str(e)
    except (DecimalException, ValueError):
        return None, "number"


def formula_column(text: str, columns: dict[str, Column], exact: bool = False) -> Column:
    """The struct (value, reason) of a formula over columns of decimal texts or arrays of them; see evaluate."""
    tree_names = sorted(names(text))
    if missing := set(tree_names) - columns.keys():
        raise FormulaError(f"names {sorted(missing)}")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        cells = zip(*(rows[n] for n in tree_names), strict=True) if tree_names else [()] * len(rows)
        return pd.DataFrame([evaluate(text, {n: None if v is None or v is pd.NA else v for n, v in zip(tree_names, c, strict=True)}, exact) for c in cells], columns=["value", "reason"])

    return F.pandas_udf(run, "value string, reason string")(F.struct(*[columns[n].alias(n) for n in tree_names] or [F.lit(1).alias("none")]))


def terminating_column(num: Column, den: Column, most_scale: int = 18, most_digits: int = 43) -> Column:
    """The decimal text of num / den (whole numbers as text) where it terminates and fits, else null."""

    def run(n: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([None if a is None or b is None or not int(b) else terminating(Fraction(int(a), int(b)), most_scale, most_digits) for a, b in zip(n, d, strict=True)], dtype=object)

    return F.pandas_udf(run, "string")(num.cast("string"), den.cast("string"))


def fits_96_bits_column(text: Column) -> Column:
    """Whether a decimal text has a coefficient under 2^96 and a scale of 0 to 28; null for null and for what is no number."""

    def one(t: object) -> bool | None:
        try:
            return None if t is None else fits_96_bits(t)
        except (DecimalException, ValueError, TypeError):
            return None

    return F.pandas_udf(lambda s: pd.Series([one(t) for t in s], dtype=object), "boolean")(text)


def single_entry_column(cash: Column, rate: Column) -> Column:
    """Value after fees of a new book of two sleeves, as num/den, from decimal texts."""

    def run(c: pd.Series, r: pd.Series) -> pd.Series:
        values = [None if a is None or b is None else single_entry_nav(Fraction(a), Fraction(b)) for a, b in zip(c, r, strict=True)]
        return pd.Series([None if v is None else f"{v.numerator}/{v.denominator}" for v in values], dtype=object)

    return F.pandas_udf(run, "string")(cash, rate)


def order_key(text: Column) -> Column:
    """A text that sorts as the decimal does, equal for equal numbers: sign, exponent and digits, turned round below zero.
    Null for what is no finite number."""

    def one(t: object) -> str | None:
        try:
            value = Decimal(t.strip()) if isinstance(t, str) else None
        except DecimalException:
            return None
        if value is None or not value.is_finite():
            return None
        if not value:
            return "1"
        digits = "".join(map(str, value.as_tuple().digits)).rstrip("0")
        body = f"{value.adjusted() + 500_000:07d}{digits}"
        return "2" + body if value > 0 else "0" + body.translate(_NINES) + "~"

    return F.pandas_udf(lambda s: pd.Series([one(t) for t in s], dtype=object), "string")(text)


_NINES = str.maketrans("0123456789", "9876543210")


def exact_ordinals(rows: DataFrame) -> DataFrame:
    """rows (formation, security_id, signal as decimal text) with ordinal, the dense rank from 0 of the distinct numbers: 1.0 and
    1.00 are one, and no two numbers are. Rows without a finite number are left out."""
    keyed = rows.withColumn("_k", order_key(F.col("signal"))).filter("_k is not null")
    return keyed.withColumn("ordinal", F.dense_rank().over(Window.partitionBy("formation").orderBy("_k")) - 1).drop("_k")


def equivalent_formulas(cases: list[tuple[str, str, str]], vectors: DataFrame) -> DataFrame:
    """(case_id, equivalent) for (case_id, expected, given): whether both formulas give the same value, or refuse alike, for every
    one of vectors, a table of decimal texts; a formula that does not parse is equivalent to none."""
    columns = {c: F.col(c) for c in vectors.columns}
    bad, parts = [], []
    for case, expected, given in cases:
        try:
            parts.append((case, formula_column(expected, columns, True), formula_column(given, columns, True)))
        except FormulaError:
            bad.append((case, False))
    spark = vectors.sparkSession
    out = spark.createDataFrame(bad, "case_id string, equivalent boolean")
    if parts:
        sums = vectors.select(*[a.eqNullSafe(b).alias(f"c{i}") for i, (_, a, b) in enumerate(parts)]).agg(*[F.bool_and(f"c{i}").alias(f"c{i}") for i in range(len(parts))])
        entries = F.array(*[F.struct(F.lit(c).alias("case_id"), F.coalesce(f"c{i}", F.lit(True)).alias("equivalent")) for i, (c, _, _) in enumerate(parts)])
        out = out.unionByName(sums.select(F.explode(entries).alias("e")).select("e.*"))
    return out
