"""Quantities in common units, chosen through identities among columns.

A reading of a text is a number and a scale (unit factor, thousands mark or decimal mark, module count). Where the text
leaves the scale open, every combination is a candidate, and the one that best satisfies an identity with other columns
is taken: the combination with the least |ln(candidate) - ln(identity)|. Identities used here:

  capacity text x unit            = capacity printed in the title x its unit
  modules x capacity of a module  = total capacity
  price text x scale              = price column x 100 centavos
  instalments x instalment        = total price

Candidates that differ in amount but are equally good make the solution non-unique; it is flagged, and so is a value that
all of its identities contradict.
Everything is built-in column expressions, one pass over the table, no exchange.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from garimpo.functions.edges import let
from garimpo.functions.text import single_spaced

# Factors to bytes of unit spellings; units are decimal unless written as binary.
BYTES = {
    "k": 10**3, "kb": 10**3, "m": 10**6, "mb": 10**6, "mega": 10**6, "megas": 10**6, "megabyte": 10**6, "megabytes": 10**6,
    "g": 10**9, "gb": 10**9, "giga": 10**9, "gigas": 10**9, "gigabyte": 10**9, "gigabytes": 10**9,
    "t": 10**12, "tb": 10**12, "tera": 10**12, "teras": 10**12, "terabyte": 10**12, "terabytes": 10**12,
    "kib": 2**10, "mib": 2**20, "gib": 2**30, "tib": 2**40,
}

#: Difference of logarithms under which two amounts count as equal (about 0.5 %; binary and decimal units differ by 2.4 % or more).
SAME = 0.005
#: Difference of logarithms up to which an identity may decide between candidates.
NEAR = 0.2
#: Residual where there is no identity.
NONE = 1e9

_UNIT = r"([kmgt]i?b|[kmgt]ega(?:byte)?s?|tera(?:byte)?s?|giga(?:byte)?s?|[kmgt])"
_NUM = r"(\d+(?:[.,]\d+)*+)"
_WIDE = "０１２３４５６７８９，．＄Ｒ×"
_PLAIN = "0123456789,.$Rx"


def plain(text: Column) -> Column:
    """Lower case, with wide digits, multiplication signs and odd spaces made ASCII."""
    return F.lower(single_spaced(F.translate(text, _WIDE, _PLAIN)))


def _get(text: Column, pattern: str, group: int = 1) -> Column:
    """The group's text, null if the pattern or the group is absent."""
    x = F.regexp_extract(text, pattern, group)
    return F.when(x != "", x)


def as_decimal(number: Column) -> Column:
    """Number text with the last mark as decimal mark: 1.234,56 and 1,234.56 are 1234.56; 1.234 is 1.234."""
    whole = F.regexp_replace(F.regexp_replace(number, r"[., ]\d*$", ""), r"\D", "")
    part = F.regexp_extract(number, r"[., ](\d*)$", 1)
    return F.concat(whole, F.lit("."), part, F.lit("0")).try_cast("decimal(30,8)").cast("double")


def as_grouped(number: Column) -> Column:
    """Number text read with its marks as thousands marks; null unless they can be (1.234, 12,345,678)."""
    return F.when(F.regexp_like(number, F.lit(r"^[1-9]\d{0,2}(\.\d{3})+$|^[1-9]\d{0,2}(,\d{3})+$|^[1-9]\d{0,2}( \d{3})+$")), F.regexp_replace(number, r"\D", "").try_cast("double"))


def _factor(unit: Column) -> Column:
    table = F.create_map(*[F.lit(x) for k, v in BYTES.items() for x in (k, float(v))])
    return table[unit]


def values(number: Column, grouped_mark: str = ".") -> Column:
    """Candidate values of a number text, the likelier first: one, or two where its only mark may be either.

    `grouped_mark`: the mark that is usually the thousands mark (a dot in Brazil).
    """
    def pick(grp: Column) -> Column:
        many = F.regexp_like(number, F.lit(r"[., ]\d+[., ]"))
        grouped_first = number.contains(grouped_mark) | number.contains(" ")
        both = F.when(grouped_first, F.array(grp, as_decimal(number))).otherwise(F.array(as_decimal(number), grp))
        return F.when(number.isNull(), F.array().cast("array<double>")).when(grp.isNull(), F.array(as_decimal(number))).when(many, F.array(grp)).otherwise(both)

    return let(as_grouped(number), pick)


def choose(candidates: Column, identities: Column) -> Column:
    """struct<amount, residual, unique> of the candidate (array<double>) nearest to any of `identities` (array<double>).

    Without a usable identity, or where none comes nearer than NEAR, it is the first candidate. `unique` is false if
    another candidate of a different amount is as near (within SAME), or if there are identities and all contradict. `residual` is
    null without an identity. No candidate: null.
    """
    def scored(pair: Column) -> Column:
        near = lambda x: F.array_min(F.transform(F.filter(pair["i"], lambda i: i > 0), lambda i: F.abs(F.ln(x) - F.ln(i))))
        return F.transform(F.filter(pair["c"], lambda x: x > 0), lambda x, k: F.struct(F.coalesce(near(x), F.lit(NONE)).alias("residual"), k.alias("k"), x.alias("amount")))

    def decide(all_: Column, best: Column) -> Column:
        decided = best["residual"] <= NEAR
        rival = F.exists(all_, lambda s: (s["residual"] <= best["residual"] + SAME) & (F.abs(F.ln(s["amount"]) - F.ln(best["amount"])) > SAME))
        return F.struct(
            F.when(decided, best["amount"]).otherwise(all_[0]["amount"]).alias("amount"),
            F.when(best["residual"] < NONE, best["residual"]).alias("residual"),
            F.when(decided, ~rival).otherwise((F.size(all_) == 1) & (best["residual"] >= NONE)).alias("unique"),
        )

    pair = F.struct(candidates.alias("c"), identities.alias("i"))
    return let(let(pair, scored), lambda all_: F.when(F.size(all_) > 0, let(F.array_min(all_), lambda best: decide(all_, best))))


def printed_capacities(title: Column) -> Column:
    """Bytes of every capacity printed in a title, kits multiplied out as well; rates (6 Gb/s, 130MB/s) are none."""
    t = plain(title)
    mention = r"\b(\d+(?:[.,]\d+)*+) ?" + _UNIT + r"\b(?!/| ?ps\b)"
    found = F.struct(F.regexp_extract_all(t, F.lit(mention), F.lit(1)).alias("n"), F.regexp_extract_all(t, F.lit(mention), F.lit(2)).alias("u"))

    def read(x: Column) -> Column:
        single = F.transform(x["n"], lambda n, i: as_decimal(n) * _factor(F.get(x["u"], i)))
        grouped = F.transform(x["n"], lambda n, i: as_grouped(n) * _factor(F.get(x["u"], i)))
        return F.concat(single, F.array_compact(grouped))

    return let(found, read)


def capacity(text: Column, title: Column | None = None) -> Column:
    """struct<amount: bytes, residual, unique> of a capacity text; null where it states no amount.

    Reads a single amount ("1,92 TB", "cap. 500GB nominal", "128 gigas"), a total with its modules ("32GB (2x16GB)",
    "64GB (2x32)") and modules to add up ("2x8GB", "8GB x 2", "2 pentes de 8GB"). A number without unit gets the unit
    for which it meets a capacity printed in `title`; without such a capacity it states no amount. A total that its own
    modules contradict is taken as it is and flagged.
    """
    count_first = rf"(\d+) ?(?:x|pentes? de|modulos? de|módulos? de|unidades? de|pecas? de|peças? de) ?{_NUM} ?{_UNIT}\b"
    size_first = rf"{_NUM} ?{_UNIT} ?x ?(\d+)\b"
    total = rf"{_NUM} ?{_UNIT} ?\("
    inside = rf"\( ?(\d+) ?(?:x|pentes? de|modulos? de|módulos? de) ?{_NUM} ?{_UNIT}?"
    one = rf"{_NUM} ?{_UNIT}\b"
    bare = r"^(\d+(?:[.,]\d+)*+)$"

    def read(t: Column) -> Column:
        null = F.lit(None).cast("string")
        kit = lambda p, k: _get(t, inside, k) if p == total else null
        part = lambda p, n, u, m: F.struct(
            _get(t, p, n).alias("n"), (_get(t, p, u) if u else null).alias("u"), (_get(t, p, m) if m else F.lit("1")).alias("m"), kit(p, 1).alias("mk"), kit(p, 2).alias("ms"), kit(p, 3).alias("mu")
        )
        has = lambda p: F.regexp_like(t, F.lit(p))
        return (
            F.when(has(total), part(total, 1, 2, 0)).when(has(count_first), part(count_first, 2, 3, 1)).when(has(size_first), part(size_first, 1, 2, 3))
            .when(has(one), part(one, 1, 2, 0)).when(has(bare), part(bare, 1, 0, 0))
        )

    def resolve(x: Column) -> Column:
        scales = F.when(x["u"].isNotNull(), F.array(_factor(x["u"]))).otherwise(F.array(*[F.lit(float(BYTES[u])) for u in ("gb", "tb", "mb")]))
        candidates = let(scales, lambda ss: F.flatten(F.transform(values(x["n"]), lambda v: F.transform(ss, lambda s: v * x["m"].try_cast("double") * s))))
        printed = F.array().cast("array<double>") if title is None else F.coalesce(printed_capacities(title), F.array().cast("array<double>"))
        open_ = x["u"].isNull() | F.regexp_like(x["n"], F.lit(r"^[1-9]\d{0,2}([.,]\d{3})+$"))  # only these need the title
        modules = F.array_compact(F.array(as_decimal(x["ms"]) * x["mk"].try_cast("double") * F.coalesce(_factor(x["mu"]), _factor(x["u"]))))
        found = choose(candidates, F.concat(F.when(open_, printed).otherwise(F.array().cast("array<double>")), modules))
        return let(found, lambda f: F.when(x["u"].isNotNull() | (f["residual"] <= NEAR), f))

    return let(let(plain(text), read), lambda x: F.when(x.isNotNull(), resolve(x)))


def price(text: Column, known: Column | None = None) -> Column:
    """struct<amount: centavos, residual, unique> of a Brazilian price text; null where it states no amount.

    Taken is what is asked now: the price after "por" rather than after "de", the cash price rather than instalments, and
    instalments times their count if nothing else is stated. "mil" is a factor of a thousand. Between a decimal and a
    thousands reading the price column `known` (in reais) decides where it is filled, else the total of instalments beside it.
    """
    amount = r"(?:r\s*\$|brl)?\s*(\d+(?:[., ]\d+)*+)( ?mil\b)?"
    parts = r"(\d+) ?x ?(?:de )?" + amount
    asked = r"\bpor " + amount
    both = r"(\d+(?:[.,]\d+)*+) reais e (\d+) centavos?"
    cents = r"^\D*(\d+(?:[.,]\d{3})*) centavos?"
    none = F.array().cast("array<double>")
    digits = lambda x: F.regexp_replace(x, r"\D", "").try_cast("double")

    def scaled(t: Column, pattern: str, number: int, times: Column | None = None) -> Column:
        unit = F.when(_get(t, pattern, number + 1).isNotNull(), F.lit(100_000.0)).otherwise(F.lit(100.0)) * (F.lit(1.0) if times is None else times)
        return let(unit, lambda u: F.transform(values(_get(t, pattern, number)), lambda x: x * u))

    def read(t: Column) -> Column:
        has = lambda p: F.regexp_like(t, F.lit(p))
        cash = let(
            F.when(t.contains("x"), F.regexp_replace(t, parts, " ")).otherwise(t),
            lambda c: F.when(F.regexp_like(c, F.lit(asked)), scaled(c, asked, 1)).when(F.regexp_like(c, F.lit(r"\d")), scaled(c, amount, 1)),
        )
        instalments = F.when(has(parts), scaled(t, parts, 2, _get(t, parts, 1).try_cast("double")))
        in_words = F.when(has(both), F.array(digits(_get(t, both, 1)) * 100 + digits(_get(t, both, 2)))).when(has(cents), F.array(digits(_get(t, cents, 1))))
        return F.when(F.regexp_like(t, F.lit(r"\d")), F.coalesce(F.when(t.contains("centavo"), in_words), cash, instalments))

    def total_of_parts(t: Column) -> Column:
        """Instalments times their count, in each reading, where a cash price stands beside them."""
        beside = t.contains("x") & F.regexp_like(F.regexp_replace(t, parts, " "), F.lit(r"\d"))
        return F.when(beside, F.coalesce(scaled(t, parts, 2, _get(t, parts, 1).try_cast("double")), none)).otherwise(none)

    by_column = none if known is None else F.when(known > 0, F.array(known * 100)).otherwise(none)
    both_of = lambda t: F.struct(read(t).alias("c"), F.when(F.size(by_column) > 0, by_column).otherwise(total_of_parts(t)).alias("i"))
    return let(let(plain(text), both_of), lambda x: F.when(F.size(x["c"]) > 0, choose(x["c"], x["i"])))


def _amount(found: Column) -> Column:
    return F.floor(found["amount"] + F.lit(0.5)).cast("long")


def in_common_units(df: DataFrame, fields: Sequence[tuple[str, Column, str]], name: str, id_column: str = "id") -> DataFrame:
    """(tablename, id, field, amount, unique): the readable values of df that are not already in their usual form.

    `fields`: (column, reading as by `capacity` or `price`, pattern of the usual form). Nulls, empty texts and texts
    without an amount give no row; rows delivered twice give one. Columns other than the id and the fields are not read.
    """
    boxes = [F.when(F.col(c).isNotNull() & ~F.regexp_like(F.col(c), F.lit(usual)), F.struct(F.lit(c).alias("field"), found.alias("found"))) for c, found, usual in fields]
    rows = df.select(F.col(id_column).alias("id"), F.explode(F.filter(F.array(*boxes), lambda b: b["found"].isNotNull())).alias("b"))
    return rows.select(F.lit(name).alias("tablename"), "id", F.col("b.field").alias("field"), _amount(F.col("b.found")).alias("amount"), F.col("b.found.unique").alias("unique")).distinct()


# The usual forms.
USUAL_CAPACITY = r"^[0-9]+GB$"
USUAL_PRICE = r"^R\$ [0-9]{1,3}(\.[0-9]{3})*,[0-9]{2}$"
