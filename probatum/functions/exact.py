"""Exact comparison of printed numbers with stored ones, on their written form, for any number of digits.

A number is held as sign, significant digits and the power of ten of its first digit, all taken from the text by
built-in expressions, so nothing is rounded and no exponent is ever written out. "Half-even, either neighbour at an
exact tie" then means: of the stored value, in units of the last place printed, the whole part agrees where what is
left over is a half or less, and the whole part plus one where it is a half or more. Numbers written plainly with few
digits, nearly all of them, take decimals instead. Tolerances and means need products: for numbers written plainly
decimals hold them, the rest are fractions in Python.
Null or unreadable operands give null, which callers report as not numeric.
"""

from __future__ import annotations

import decimal
import fractions
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from probatum.functions.arrow import arrow

DECIMAL = "decimal(38,9)"
NUMBER = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d{1,9})?$"
#: Numbers that decimals of 38 and 18 digits with nine places hold, written plainly.
PLAIN = r"^[+-]?\d{1,18}(?:\.\d{1,9})?$"
SHORT = r"^[+-]?\d{1,9}(?:\.\d{1,9})?$"
#: Beyond this power of ten a number is rendered with an exponent.
PLAIN_UP_TO = 100


def _text(value: Column | str) -> Column:
    return F.trim((F.col(value) if isinstance(value, str) else value).cast("string"))


def is_number(written: Column | str) -> Column:
    """Whether a text states a finite decimal; null where there is no text."""
    return _text(written).rlike(NUMBER)


def _exponent(text: Column) -> Column:
    return F.coalesce(F.regexp_extract(text, r"[eE]([+-]?\d+)$", 1).try_cast("long"), F.lit(0).cast("long"))


def printed_places(reported: Column | str) -> Column:
    """Decimal places as printed; negative where an exponent makes the last digit count tens or more."""
    c = _text(reported)
    dot = F.instr(c, ".")
    plain = F.when(dot > 0, F.length(c) - dot).otherwise(0)
    written = F.length(F.regexp_extract(c, r"\.(\d*)", 1)) - _exponent(c).cast("int")
    return F.when(c.isNull(), None).when(c.contains("e") | c.contains("E") | c.contains("%"), written).otherwise(plain)


def number(text: Column | str) -> Column:
    """The decimal a text states, to nine places: for ranges and orders, never for agreement."""
    return F.trim(F.col(text) if isinstance(text, str) else text).try_cast(DECIMAL)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def written(number_: Column | str, shift: Column | int = 0) -> Column:
    """The parts of a written number times 10 ** shift: ok; negative; digits without zeros at either end ('' for zero);
    exponent, which makes its value 0.digits * 10 ** exponent; places printed; key, one text for all ways to write it."""
    move = F.lit(shift).cast("long") if isinstance(shift, int) else F.coalesce(shift.cast("long"), F.lit(0).cast("long"))
    cut = lambda t: F.struct(
        F.coalesce(t.rlike(NUMBER), F.lit(False)).alias("ok"),
        F.startswith(t, F.lit("-")).alias("minus"),
        F.regexp_extract(t, r"^[+-]?(\d*)", 1).alias("whole"),
        F.regexp_extract(t, r"\.(\d*)", 1).alias("fraction"),
        (_exponent(t) + move).alias("moved"),
    )
    lead = lambda p: F.struct(p.alias("p"), F.ltrim(F.concat(p["whole"], p["fraction"]), F.lit("0")).alias("led"))
    parts = lambda q: F.struct(
        q["p"]["ok"].alias("ok"),
        (q["p"]["minus"] & (q["led"] != "")).alias("negative"),
        F.rtrim(q["led"], F.lit("0")).alias("digits"),
        F.when(q["led"] == "", F.lit(0).cast("long")).otherwise(F.length(q["led"]) - F.length(q["p"]["fraction"]) + q["p"]["moved"]).alias("exponent"),
        (F.length(q["p"]["fraction"]) - q["p"]["moved"]).alias("places"),
    )
    keyed = lambda w: w.withField("key", _key(w["negative"], w["digits"], w["exponent"]))
    return let(_text(number_), lambda t: let(cut(t), lambda p: let(lead(p), lambda q: let(parts(q), keyed))))


def _key(negative: Column, digits: Column, exponent: Column) -> Column:
    return F.when(digits == "", "0").otherwise(F.concat(F.when(negative, "-").otherwise(""), digits, F.lit("e"), exponent.cast("string")))


def _neighbours(s: Column, places: Column) -> Column:
    """struct(down, up, rest): keys of the whole part and of one more, and what is left over, in units of 10 ** -places."""
    size = F.length(s["digits"])
    units = lambda at: F.struct(
        at.alias("at"),
        F.greatest(F.least(at, size.cast("long")), F.lit(0).cast("long")).cast("int").alias("cut"),
    )
    split = lambda u: F.struct(
        u["cut"].alias("cut"),
        F.substr(s["digits"], F.lit(1), u["cut"]).alias("head"),
        F.when(s["digits"] == "", "").when(u["at"] < 0, "0").otherwise(F.substr(s["digits"], u["cut"] + 1, size)).alias("rest"),
        F.rtrim(F.substr(s["digits"], F.lit(1), u["cut"]), F.lit("9")).alias("left"),  # nines at the end turn to zeros, the digit before them goes up
    )
    raised = lambda h: F.when(h["left"] == "", "1").otherwise(
        F.concat(F.substr(h["left"], F.lit(1), F.length(h["left"]) - 1), (F.substr(h["left"], F.length(h["left"]), F.lit(1)).try_cast("int") + 1).cast("string"))
    )
    both = lambda h: F.struct(
        _key(s["negative"], F.rtrim(h["head"], F.lit("0")), s["exponent"]).alias("down"),
        _key(s["negative"], raised(h), F.when(h["left"] == "", h["cut"] + 1).otherwise(h["cut"]) - places).alias("up"),
        h["rest"].alias("rest"),
    )
    return let(s["exponent"] + places, lambda at: let(units(at), lambda u: let(split(u), both)))


def key_of(number_: Column | str, shift: Column | int = 0) -> Column:
    return let(written(number_, shift), lambda w: F.when(w["ok"], w["key"]))


def roundings(number_: Column | str, places: Column, shift: Column | int = 0) -> Column:
    """Keys of what a number rounds to at so many places: one, or both neighbours at a tie."""
    found = lambda n: F.array_compact(F.array(F.when(n["rest"] <= "5", n["down"]), F.when(n["rest"] >= "5", n["up"])))
    return let(written(number_, shift), lambda s: F.when(s["ok"], let(_neighbours(s, places), found)))


def _meets(stored: Column | str, reported: Column | str, shift: Column | int, test: Callable[[Column, Column], Column]) -> Column:
    inner = lambda s, r: F.when(s["ok"] & r["ok"], let(_neighbours(s, r["places"]), lambda n: test(n, r["key"])))
    return let(written(stored, shift), lambda s: let(written(reported), lambda r: inner(s, r)))


def _plain(*numbers: Column | str) -> Column:
    """Whether all are written plainly with few digits, so that decimals hold them and twice their differences."""
    out = F.lit(True)
    for n in numbers:
        out &= _text(n).rlike(PLAIN)
    return out


def _quantum_of(text: Column) -> Column:
    """One unit of the last place of a number written plainly with at most nine places."""
    dot = F.instr(text, ".")
    places = F.when(dot > 0, F.length(text) - dot).otherwise(0)
    return F.try_element_at(F.array(*[F.lit(str(decimal.Decimal(1).scaleb(-k))).cast("decimal(10,9)") for k in range(10)]), places + 1)


def agrees(stored: Column | str, reported: Column | str, shift: Column | int = 0) -> Column:
    """Whether stored, moved by shift places, rounds to reported at the precision printed."""
    r = _text(reported)
    held = lambda x: x.try_cast("decimal(28,9)")  # noqa: E731  # narrow enough that the difference keeps every place
    near = (F.abs(held(_text(stored)) - held(r)) * F.lit(2).cast("decimal(1,0)")) <= _quantum_of(r)
    exact = _meets(stored, reported, shift, lambda n, k: ((n["down"] == k) & (n["rest"] <= "5")) | ((n["up"] == k) & (n["rest"] >= "5")))
    unmoved = F.lit(shift == 0) if isinstance(shift, int) else (F.coalesce(shift, F.lit(0)) == 0)
    return F.when(unmoved & _plain(stored, reported), near).otherwise(exact)


def is_tie(stored: Column | str, reported: Column | str, shift: Column | int = 0) -> Column:
    """Whether stored lies halfway between two printed values of which reported is one."""
    return _meets(stored, reported, shift, lambda n, k: ((n["down"] == k) | (n["up"] == k)) & (n["rest"] == "5"))


def shift_of(conversion: Column | str) -> Column:
    """percent moves a stored fraction two places up, fraction a stored percentage two places down."""
    c = F.col(conversion) if isinstance(conversion, str) else conversion
    return F.when(c == "percent", 2).when(c == "fraction", -2).otherwise(0)


def shifted(number_: Column | str, shift: Column) -> Column:
    """A number moved by shift places as text that keeps its digits and so its precision."""
    t = _text(number_)
    return F.when(shift == 0, t).otherwise(F.concat(F.regexp_replace(t, r"[eE].*$", ""), F.lit("e"), (_exponent(t) + shift).cast("string")))


def rendered(number_: Column | str) -> Column:
    """A number without an exponent, every place written out; beyond 10 ** 100 as it is."""
    t = _text(number_)
    parts = lambda w: F.struct(w.alias("w"), F.regexp_replace(F.regexp_replace(t, r"[eE].*$", ""), r"[+.-]", "").alias("bare"))
    end = lambda p: F.length(p["bare"])
    at = lambda p: (F.length(p["bare"]) - p["w"]["places"]).cast("int")  # noqa: E731  # where the point stands among the digits
    zeros = lambda n: F.repeat(F.lit("0"), n)
    whole = lambda p, x: F.when(x <= 0, "0").when(x >= end(p), F.concat(p["bare"], zeros(x - end(p)))).otherwise(F.substr(p["bare"], F.lit(1), x))
    part = lambda p, x: F.when(x <= 0, F.concat(zeros(-x), p["bare"])).when(x >= end(p), "").otherwise(F.substr(p["bare"], x + 1, end(p)))
    joined = lambda p, x: F.concat(
        F.when(F.startswith(t, F.lit("-")), "-").otherwise(""), F.regexp_replace(whole(p, x), r"^0+(?=\d)", ""), F.when(part(p, x) == "", "").otherwise(F.concat(F.lit("."), part(p, x)))
    )
    out = lambda p: F.when(~p["w"]["ok"], None).when(F.abs(p["w"]["exponent"]) > PLAIN_UP_TO, t).otherwise(let(at(p), lambda x: joined(p, x)))
    return let(written(number_), lambda w: let(parts(w), out))


def _exact(text: str | None) -> fractions.Fraction | None:
    try:
        return fractions.Fraction(decimal.Decimal(text.strip()))
    except (AttributeError, decimal.InvalidOperation, ValueError, OverflowError):
        return None


def _quantum(text: str) -> fractions.Fraction:
    return fractions.Fraction(10) ** decimal.Decimal(text.strip()).as_tuple().exponent


@arrow("boolean")
def _within_long(stored: pd.Series, reported: pd.Series, relative: pd.Series, tolerance: pd.Series) -> pd.Series:
    def one(s, r, m, t):
        s, r, t = _exact(s), _exact(r), _exact(t)
        return None if s is None or r is None or t is None else abs(s - r) <= (t * abs(r) if m else t)

    return pd.Series([one(*x) for x in zip(stored, reported, relative, tolerance)], dtype=object)


def within(stored: Column | str, reported: Column | str, mode: Column | str, tolerance: Column | str) -> Column:
    """absolute: |s - r| <= t; relative: |s - r| <= t * |r|. Any number of digits."""
    relative = F.coalesce((F.col(mode) if isinstance(mode, str) else mode) == "relative", F.lit(False))
    small = lambda c: _text(c).try_cast("decimal(18,9)")
    gap = F.abs(small(stored) - small(reported))
    near = F.when(relative, gap <= small(tolerance) * F.abs(small(reported))).otherwise(gap <= small(tolerance))

    short = F.coalesce(_text(stored).rlike(SHORT) & _text(reported).rlike(SHORT) & _text(tolerance).rlike(SHORT), F.lit(False))
    only = lambda c: F.when(~short, _text(c))
    return F.when(short, near).otherwise(_within_long(only(stored), only(reported), relative, only(tolerance)))


def within_decimals(stored: Column, reported: Column, mode: Column | str, tolerance: Column) -> Column:
    """The same for columns of decimals of at most nine digits before the point and nine after it, in the JVM alone."""
    relative = F.coalesce((F.col(mode) if isinstance(mode, str) else mode) == "relative", F.lit(False))
    s, r, t = (c.cast("decimal(18,9)") for c in (stored, reported, tolerance))
    return F.abs(s - r) <= F.when(relative, t * F.abs(r)).otherwise(t)


@arrow("boolean")
def _mean_long(total: pd.Series, count: pd.Series, reported: pd.Series) -> pd.Series:
    def one(s, n, r):
        s, x = _exact(s), _exact(r)
        return None if s is None or x is None or pd.isna(n) or not n else 2 * abs(s - int(n) * x) <= int(n) * _quantum(r)

    return pd.Series([one(*x) for x in zip(total, count, reported)], dtype=object)


def mean_agrees(total: Column, count: Column, reported: Column | str) -> Column:
    """A mean against its printed form without dividing: 2 * |sum - n * r| <= n * q. Any number of digits."""
    n = F.when(count.between(1, 10**10 - 1), count).cast("decimal(10,0)")
    r = _text(reported)
    held = _text(total).try_cast("decimal(28,9)") - n * r.try_cast("decimal(18,9)")
    near = F.abs(held) * F.lit(2).cast("decimal(1,0)") <= n * _quantum_of(r)
    short = F.coalesce(_plain(total) & r.rlike(SHORT) & n.isNotNull(), F.lit(False))
    only = lambda c: F.when(~short, _text(c))
    return F.when(short, near).otherwise(_mean_long(only(total), count, only(reported)))


@arrow("boolean")
def statistic_of_members(statistic: pd.Series, members: pd.Series, reported: pd.Series) -> pd.Series:
    """Whether a statistic of the few members an author declared agrees with its printed form; fractions throughout."""

    def one(kind, texts, r):
        x = _exact(r)
        values = [] if texts is None else sorted(v for t in texts if (v := _exact(t)) is not None)
        if x is None or not values or len(values) < len(texts):
            return None
        n = len(values)
        found = {
            "mean": lambda: sum(values) / n, "median": lambda: (values[(n - 1) // 2] + values[n // 2]) / 2, "min": lambda: values[0],
            "max": lambda: values[-1], "sum": lambda: sum(values), "count": lambda: fractions.Fraction(n),
        }.get(kind)
        return None if found is None else 2 * abs(found() - x) <= _quantum(r)

    return pd.Series([one(*x) for x in zip(statistic, members, reported)], dtype=object)


def printed_agree(a: Column, b: Column) -> Column:
    """Two printed texts agree at the coarser of their precisions."""
    return F.when(printed_places(a) >= printed_places(b), agrees(a, b)).otherwise(agrees(b, a))


def same_number(a: Column | str, b: Column | str) -> Column:
    """Whether two texts state one number, however written; null where either states none."""
    return key_of(a) == key_of(b)


def significant_digits(written: Column | str) -> Column:
    """Digits that say something: zeros in front never do, zeros at the end only after a decimal point."""
    c = F.col(written) if isinstance(written, str) else written
    mantissa = F.regexp_replace(F.regexp_replace(c, r"[eE].*$", ""), r"[^0-9.]", "")
    digits = F.regexp_replace(F.regexp_replace(mantissa, r"\.", ""), r"^0+", "")
    return F.length(F.when(mantissa.contains("."), digits).otherwise(F.regexp_replace(digits, r"0+$", "")))


def canonical(written: Column | str) -> Column:
    """A printed number without grouping commas, plus sign, percent sign, or zeros that say nothing."""
    c = F.col(written) if isinstance(written, str) else written
    bare = F.regexp_replace(F.regexp_replace(F.trim(c), r"(?<=\d),(?=\d{3})", ""), r"^\+|%$", "")
    no_fraction_zeros = F.when(bare.contains("."), F.regexp_replace(F.regexp_replace(bare, r"0+$", ""), r"\.$", "")).otherwise(bare)
    return F.regexp_replace(no_fraction_zeros, r"^(-?)0+(?=\d)", "$1")
