"""Records that are the same but for their way of writing, found by commutative multiset hashing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphgrove.runtime import apart, durable

#: Every sign that counts as white space, Unicode included, as ranges of a character class.
SPACE = "\\u0009-\\u000D\\u001C-\\u0020\\u0085\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"
#: Marks without meaning.
MARKS = ".,;:!?'\"$`"


def normal_form(value: Column) -> Column:
    """Value without white space, marks and letter case; null becomes empty.

    Upper case first, then lower case, makes one form of letters with several lower-case shapes; the sharp s,
    which has a two-letter upper case, is written out.
    """
    bare = F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), f"[{SPACE}{MARKS}]", "")
    return F.replace(F.lower(F.upper(bare)), F.lit("ß"), F.lit("ss"))


def fingerprint(fields: list[tuple[str, Column]]) -> list[Column]:
    """Multiset hash of (name, value) pairs: two independent sums of pair hashes.

    Addition commutes, so the order of the pairs doesn't matter and nothing is sorted; pairs that occur twice
    count twice. Hashes lose as many low bits as their sum could overflow by, eight at least.
    """
    spare = max(8, len(fields).bit_length())

    def total(salt: str) -> Column:
        return reduce(lambda x, y: x + y, [F.shiftrightunsigned(F.xxhash64(F.lit(salt), F.lit(n), v), spare) for n, v in fields])

    return [total("a"), total("b")]


def _same_multiset(left: list[Column], right: list[Column]) -> Column:
    """Whether two short lists hold the same values equally often, by counting and not by sorting."""
    times = lambda x, ys: reduce(lambda p, q: p + q, [(x == y).cast("int") for y in ys])
    return reduce(lambda p, q: p & q, [times(x, left) == times(x, right) for x in left])


def find_copies(records: DataFrame, ident: str, fields: dict[str, str]) -> DataFrame:
    """``kept_id, ident``: each record that repeats another, with the smallest id of its copies.

    ``fields`` maps columns to field names. Columns with the same field name are interchangeable, i.e. values
    may stand in either of them. Copies agree in all fields after :func:`normal_form`; records whose values are
    all empty are copies of each other.

    Records meet by fingerprint: an aggregate over numbers only finds the fingerprints of more than one record, and
    just the values of those records are shuffled and kept in the checkpoint folder. Each is then compared value by
    value with its group's kept record, so a chance hash collision joins nothing; what fails that comparison is grouped
    again by its values. A group with a third of all records is one row after the aggregate and a hot key of the
    joins, whose two sides are each shuffled for them, so that adaptive execution splits it.
    """
    cols = list(fields)
    names = [f"_v{i}" for i in range(len(cols))]
    base = records.select(F.col(ident).alias("_id"), *[normal_form(F.col(c)).alias(n) for c, n in zip(cols, names, strict=True)])
    f = ["_f1", "_f2"]
    base = base.withColumns(dict(zip(f, fingerprint([(fields[c], F.col(n)) for c, n in zip(cols, names, strict=True)]), strict=True)))
    groups = base.groupBy(*f).agg(F.min("_id").alias("_first"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    members = durable(base.join(apart(groups, *f), f))
    kept = members.filter("_id = _first").select(*f, F.struct(*names).alias("_k"))
    by_field: dict[str, list[str]] = {}
    for c, n in zip(cols, names, strict=True):
        by_field.setdefault(fields[c], []).append(n)
    equal = reduce(lambda p, q: p & q, [_same_multiset([F.col(n) for n in ns], [F.col("_k")[n] for n in ns]) for ns in by_field.values()])
    met = members.join(kept, f).withColumn("_equal", equal)
    copies = met.filter(F.col("_equal") & (F.col("_id") != F.col("_first"))).select(F.col("_first").alias("kept_id"), F.col("_id").alias(ident))
    # chance collisions: the same fingerprint, other values; as good as never a row
    exact = [F.array_sort(F.array(*ns)).alias(f"_e{i}") for i, ns in enumerate(by_field.values())]
    keys = [*f, *[f"_e{i}" for i in range(len(exact))]]
    strays = durable(met.filter(~F.col("_equal")).select(*f, "_id", *exact))
    first = strays.groupBy(*keys).agg(F.min("_id").alias("kept_id"))
    rest = strays.join(apart(first, *keys), keys).filter("_id <> kept_id").select("kept_id", F.col("_id").alias(ident))
    return copies.unionByName(rest)


def collapse(records: DataFrame, ident: str, fields: dict[str, str]) -> DataFrame:
    """``kept_id, n_copies``: one row per distinct record with the number of its copies, itself included."""
    copies = find_copies(records, ident, fields)
    surplus = apart(copies.groupBy(F.col("kept_id").alias("_kept")).agg(F.count("*").alias("_n")), "_kept")
    single = records.select(F.col(ident).alias("kept_id")).join(copies.select(F.col(ident).alias("kept_id")), "kept_id", "left_anti")
    return single.join(surplus, F.col("kept_id") == F.col("_kept"), "left").select("kept_id", (F.coalesce("_n", F.lit(0)) + 1).alias("n_copies"))
