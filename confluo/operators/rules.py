"""Declared rules of tables with nested rows, compiled to few passes.

All rules about one row, however deep, become one array of faults that is made in the scan of its table. All uniqueness rules of
a table become one aggregate over the values they watch, and all references to one table one anti join, whichever rules they
come from. So the number of passes goes with the number of tables, not of rules.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Get = Callable[[str], Column]
FAULT = "array<struct<path: string, rule: string>>"


@dataclass(frozen=True)
class Rule:
    """A fault at `path` where `broken` is true; null counts as false. `broken` gets the fields of its row by name."""

    path: str
    rule: str
    broken: Callable[[Get], Column]


@dataclass(frozen=True)
class Each:
    """Rules for the members of a list: `rows` gives it from the row around. A member's path is its place, or what `label` says."""

    path: str
    rows: Callable[[Get], Column]
    rules: Sequence[Rule | Each]
    label: Callable[[Column], Column] | None = None


@dataclass(frozen=True)
class Reference:
    """Every id that `ids` gives (an array; nulls count as empty text) is the id of a row of `table`."""

    path: str
    table: str
    ids: Callable[[Get], Column]
    rule: str = "unknown reference"


@dataclass(frozen=True)
class Unique:
    """Every value that `value` gives (an array, so that a value may be unique within its row: put the row's id before it) occurs once."""

    path: str
    value: Callable[[Get], Column]
    rule: str = "duplicate"


@dataclass(frozen=True)
class Table:
    name: str
    id: str
    rules: Sequence[Rule | Each] = ()
    unique: Sequence[Unique] = ()
    references: Sequence[Reference] = field(default_factory=tuple)


def faults(rules: Sequence[Rule | Each], get: Get, prefix: Column) -> Column:
    """The faults of one row as an array."""
    own = [r for r in rules if isinstance(r, Rule)]
    at = lambda path: F.concat(prefix, F.lit(path)) if path else prefix
    out = F.array_compact(F.array(*[F.when(r.broken(get), F.struct(at(r.path).alias("path"), F.lit(r.rule).alias("rule"))) for r in own])) if own else F.array().cast(FAULT)

    def of_member(e: Each) -> Callable[[Column, Column], Column]:
        place = lambda x, i: e.label(x) if e.label else F.concat(F.lit("["), i.cast("string"), F.lit("]"))
        return lambda x, i: faults(e.rules, lambda c: x[c], F.concat(at(e.path), place(x, i)))

    for e in rules:
        if isinstance(e, Each):
            out = F.concat(out, F.coalesce(F.flatten(F.transform(e.rows(get), of_member(e))), F.array().cast(FAULT)))
    return out


def row_faults(df: DataFrame, table: Table) -> DataFrame:
    """(table, id, path, rule) of all row rules, in one scan."""
    # Exploded as it is made: of a column of its own Spark infers a filter, and states all rules again in it, with all that they read.
    found = df.select(F.col(table.id).cast("string").alias("_id"), F.explode(faults(table.rules, F.col, F.lit(""))).alias("_f"))
    return found.select(F.lit(table.name).alias("table"), F.col("_id").alias("id"), F.regexp_replace("_f.path", r"^\.", "").alias("path"), "_f.rule")


def watched(df: DataFrame, table: Table, what: Sequence[Unique | Reference]) -> DataFrame:
    """(id, n, value, i): the values that rules watch; n is the rule's place, i the value's."""
    values = lambda w: w.value(F.col) if isinstance(w, Unique) else w.ids(F.col)
    text = lambda w: F.transform(F.coalesce(values(w), F.array()), lambda v: F.coalesce(v.cast("string"), F.lit("")))
    tagged = lambda n: lambda v, i: F.struct(F.lit(n).alias("n"), v.alias("value"), i.alias("i"))
    each = [F.transform(text(w), tagged(n)) for n, w in enumerate(what)]
    return df.select(F.col(table.id).cast("string").alias("_id"), F.explode(F.flatten(F.array(*each))).alias("_v")).select(F.col("_id").alias("id"), "_v.*")


def named(what: Sequence[Unique | Reference], n: Column, names: Callable) -> Column:
    return F.element_at(F.array(*[F.lit(names(w)) for w in what]), n + 1)


def duplicates(df: DataFrame, table: Table) -> DataFrame:
    """A fault for each value that occurs again, at the row with the least id that bears it; null and empty values aside."""
    rows = watched(df, table, table.unique).filter("value <> ''")
    again = rows.groupBy("n", "value").agg(F.count("*").alias("times"), F.min("id").alias("id")).filter("times > 1")
    n = F.col("n")
    return again.select(F.lit(table.name).alias("table"), "id", F.concat(named(table.unique, n, lambda w: w.path), F.lit("="), "value").alias("path"), named(table.unique, n, lambda w: w.rule).alias("rule"))


def lost_references(frames: dict[str, DataFrame], tables: Sequence[Table], target: Table) -> DataFrame | None:
    """Faults of all rules of all tables that refer to `target`, by one anti join."""
    asking = [(t, [r for r in t.references if r.table == target.name]) for t in tables]
    asking = [(t, own) for t, own in asking if own]
    if not asking:
        return None
    all_of = []
    for t, own in asking:
        n = F.col("n")
        path = F.concat(named(own, n, lambda w: w.path), F.lit("["), F.col("i").cast("string"), F.lit("]"))
        all_of.append(watched(frames[t.name], t, own).select(F.lit(t.name).alias("table"), "id", path.alias("path"), named(own, n, lambda w: w.rule).alias("rule"), "value"))
    known = frames[target.name].select(F.col(target.id).cast("string").alias("value"))
    return reduce(lambda a, b: a.unionByName(b), all_of).join(known, "value", "left_anti").drop("value")


def violations(frames: dict[str, DataFrame], tables: Sequence[Table]) -> DataFrame:
    """(table, id, path, rule): every fault of every row of the given tables."""
    found = []
    for t in tables:
        if t.rules:
            found.append(row_faults(frames[t.name], t))
        if t.unique:
            found.append(duplicates(frames[t.name], t))
        if (lost := lost_references(frames, tables, t)) is not None:
            found.append(lost)
    return reduce(lambda a, b: a.unionByName(b), found)


# ---- conditions ---------------------------------------------------------------------------------------------------


def true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def blank(c: Column) -> Column:
    """Null, or nothing but white space."""
    return true(F.trim(F.coalesce(c, F.lit(""))) == "")


def none_of(c: Column, values: Sequence[str]) -> Column:
    return ~true(c.isin(*values))


def bad_date(c: Column) -> Column:
    return ~true(c.rlike(r"^\d{4}-\d{2}-\d{2}\z") & F.try_to_timestamp(c, F.lit("yyyy-MM-dd")).isNotNull())


def bad_time(c: Column) -> Column:
    return ~true(c.rlike(r"^([01]\d|2[0-3]):[0-5]\d\z"))


def bad_url(c: Column) -> Column:
    return ~true(c.rlike(r"^(?i:https?)://[^\s/?#]+"))


def bad_instant(c: Column) -> Column:
    return F.try_to_timestamp(c).isNull()


def empty(c: Column) -> Column:
    """A null or empty list."""
    return F.coalesce(F.size(c), F.lit(0)) <= 0


def outside(c: Column, low: float, high: float | None = None) -> Column:
    """Null, not a number, or outside of [low, high]."""
    n = c.cast("double")
    fine = ~F.isnan(n) & (n >= low) & (n < float("inf"))
    return ~true(fine & (n <= high) if high is not None else fine)
