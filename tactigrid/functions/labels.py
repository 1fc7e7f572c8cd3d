"""Scalar functions of names, labels and numbers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def slug(c: Column) -> Column:
    """Lower case, runs of other than a-z and 0-9 as one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-|-$", "")


def slot(c: Column) -> Column:
    """Whether a label is A or B with a number, and perhaps ~ and a number."""
    return F.coalesce(c.rlike(r"^[AB]\d+(~\d+)?$"), F.lit(False))


def jersey(c: Column) -> Column:
    """A shirt number of one or two digits from 1 to 99, without leading zeros; else null."""
    return F.when(c.rlike(r"^[1-9]\d?$"), c.cast("int"))


def ordered_label(c: Column, bounds: list[tuple[float, str]], otherwise: str) -> Column:
    """The label of the first bound that c reaches, from the highest on; null stays null."""
    out = F.when(c.isNull(), None)
    for least, name in bounds:
        out = out.when(c >= least, F.lit(name))
    return out.otherwise(F.lit(otherwise))


def ratio(a: Column, b: Column, digits: int = 4) -> Column:
    """a / b, 0 if b is 0."""
    return F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), digits)


def euclid(a: list[Column], b: list[Column]) -> Column:
    total = (a[0] - b[0]) * (a[0] - b[0])
    for p, q in zip(a[1:], b[1:], strict=True):
        total = total + (p - q) * (p - q)
    return F.sqrt(total)


def content_hash(*fields: tuple[str, Column]) -> Column:
    """SHA-256 of a JSON object of the fields in order of their names; fields that only tell the time are the caller's to leave out."""
    return F.sha2(F.to_json(F.struct(*[c.alias(n) for n, c in sorted(fields)])), 256)
