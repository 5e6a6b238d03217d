"""Generated identifiers: slugs under a parent, unique in their scope, and ids of coordinations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.text import blank_to_null, col, initials, slug

IDENTIFIER = "^[a-z0-9]+(?:[._:-][a-z0-9]+)*$"


def is_identifier(c: Column | str) -> Column:
    return F.coalesce(col(c).rlike(IDENTIFIER), F.lit(False))


def is_open_value(c: Column | str, vocabulary: list[str]) -> Column:
    """A value of the vocabulary, or others(some text)."""
    return F.coalesce(col(c).isin(vocabulary) | col(c).rlike(r"^others\(.+\)$"), F.lit(False))


#: A base that looks like another one with a suffix that this module makes.
SUFFIXED = r"^(.*)-([1-9]\d{0,17})$"


def unique_ids(rows: DataFrame) -> DataFrame:
    """rows (scope, base, pos, ...) with id: in the order of pos, the first of equal bases keeps it, later ones get -2, -3, ..., and
    nobody gets an id that is taken already. pos is unique in a scope.

    No scope is worked through row by row. The rows of a base that don't keep it take the free numbers from 2 on in turn, so the
    number of a row is its rank, and one more for each taken number that isn't above it. A number k is taken if base-k is a base
    itself and comes before its turn: that is known from the count of rows before it and of smaller taken numbers, by a fold over the sorted
    suffixes of the base. Whether base-k keeps its name decides in turn how its own rows are ranked, one level of suffixes after the other.
    Where no base looks like another with a suffix there is one window and nothing else.
    """
    bases = rows.groupBy("scope", "base").agg(F.min("pos").alias("first"))
    child = bases.select("scope", F.regexp_extract("base", SUFFIXED, 1).alias("base"), F.col("base").alias("child"), F.try_to_number(blank_to_null(F.regexp_extract("base", SUFFIXED, 2)), F.lit("9" * 18)).cast("long").alias("k"), "first")
    child = child.where("k >= 2").join(bases.select("scope", "base"), ["scope", "base"], "left_semi")
    levels = child.agg(F.max(F.size(F.split(F.regexp_extract("child", r"(?:-[1-9]\d*)+$", 0), "-")) - 1)).first()[0]
    order = W.Window.partitionBy("scope", "base").orderBy("pos")
    if levels is None:
        n = F.row_number().over(order)
        return rows.withColumn("_n", n).withColumn("id", F.when(F.col("_n") == 1, F.col("base")).otherwise(F.concat("base", F.lit("-"), F.col("_n").cast("string")))).drop("_n")

    # one pass for the ranks of rows and for how many rows stand before each base that looks like this one
    marks = child.select("scope", "base", F.col("first").alias("pos"), F.struct("k", "child").alias("_child"))
    both = rows.withColumn("_child", F.lit(None).cast("struct<k: long, child: string>")).unionByName(marks, allowMissingColumns=True)
    counted = both.withColumn("_n", F.count_if(F.col("_child").isNull()).over(order.rowsBetween(W.Window.unboundedPreceding, 0)))
    ranked = counted.where("_child is null").drop("_child")
    kids = counted.where("_child is not null").groupBy("scope", "base").agg(F.sort_array(F.collect_list(F.struct("_child.k", F.col("_n").alias("n"), "_child.child"))).alias("kids"))

    level = kids.join(child.select("scope", F.col("child").alias("base")), ["scope", "base"], "left_anti").withColumn("bare", F.lit(True))
    known = []
    for _ in range(levels):
        told = level.withColumn("kept", kept_suffixes(F.col("kids"), F.col("bare")))
        known.append(told.select("scope", "base", "bare", F.filter("kept", lambda x: x["ok"]).alias("kept")))
        after = told.select("scope", F.explode("kept").alias("x")).select("scope", F.col("x.child").alias("base"), F.col("x.ok").alias("bare"))
        known.append(after.join(kids, ["scope", "base"], "left_anti").select("scope", "base", "bare", F.array().cast("array<struct<k: long, child: string, ok: boolean>>").alias("kept")))
        level = after.join(kids, ["scope", "base"])
    every = known[0]
    for df in known[1:]:
        every = every.unionByName(df)
    # how many free numbers lie below each taken one
    free = F.transform("kept", lambda x, i: x["k"] - 2 - i)
    joined = ranked.join(every.select("scope", "base", "bare", free.alias("_free")), ["scope", "base"], "left")
    bare = F.coalesce("bare", F.lit(True))
    turn = F.col("_n") - bare.cast("int")
    number = turn + 1 + F.coalesce(F.size(F.filter("_free", lambda f: f < turn)), F.lit(0))
    own = F.when(turn == 0, F.col("base")).otherwise(F.concat("base", F.lit("-"), number.cast("string")))
    return joined.withColumn("id", own).select(*rows.columns, "id")


def kept_suffixes(kids: Column, bare: Column) -> Column:
    """Which bases with a suffix keep their name: kids are (k, n, child) by rising k, n rows of the base itself standing before. A
    base keeps it if the rows before it that need a number, and the smaller taken numbers, leave k free."""
    start = F.struct(F.lit(0).cast("long").alias("c"), F.array().cast("array<struct<k: long, child: string, ok: boolean>>").alias("made"))

    def step(held: Column, x: Column) -> Column:
        ok = x["n"] - F.when(bare & (x["n"] > 0), 1).otherwise(0) + held["c"] <= x["k"] - 2
        return F.struct((held["c"] + ok.cast("long")).alias("c"), F.array_append(held["made"], F.struct(x["k"].alias("k"), x["child"].alias("child"), ok.alias("ok"))).alias("made"))

    return F.aggregate(kids, start, step, lambda held: held["made"])


def under(parent: Column | str, own: Column | str) -> Column:
    """An id with its parent's in front, unless it has that already."""
    prefix = F.concat(col(parent), F.lit("."))
    return F.when(F.startswith(col(own), prefix), col(own)).otherwise(F.concat(prefix, col(own)))


def hierarchical_ids(rows: DataFrame) -> DataFrame:
    """Ids of three levels from names: given ids (columns view_id, subview_id, capability_id, if there are any) or slugs,
    under the parent's id, unique in it. rows: record_id and <level>_name, <level>_pos."""
    scope, parent = ["record_id"], None
    out = rows
    for level in ("view", "subview", "capability"):
        fallback = F.concat(F.lit(f"{level}-"), F.col(f"{level}_pos").cast("string"))
        made = slug(f"{level}_name", fallback)
        if f"{level}_id" in rows.columns:
            made = F.coalesce(blank_to_null(f"{level}_id"), made)
        base = made if parent is None else under(parent, made)
        keys = [*scope, f"{level}_pos"]
        named = out.select(*keys, base.alias("base")).distinct()
        got = unique_ids(named.select(F.to_json(F.struct(*scope)).alias("scope"), "base", F.col(f"{level}_pos").alias("pos"), *keys))
        out = out.drop(f"{level}_id").join(got.select(*keys, F.col("id").alias(f"{level}_id")), keys)
        scope, parent = keys, f"{level}_id"
    return out


def short_ref(view: Column, subview: Column) -> Column:
    local = F.regexp_replace(subview, r"^[^.]*\.", "")
    return F.when(blank_to_null(subview).isNull(), initials(view)).otherwise(F.concat(initials(view), F.lit("-"), initials(local)))


def coordination_id(view: Column, subview: Column, kind: Column, targets: Column) -> Column:
    """Initials of source and kind, and six digits of a digest of source, kind and all targets (structs view_id, subview_id)."""
    told = F.transform(targets, lambda t: F.concat(t["view_id"], F.lit(":"), F.coalesce(t["subview_id"], F.lit(""))))
    payload = F.concat_ws("|", F.array(view, F.coalesce(subview, F.lit("")), kind), told)
    return F.concat(F.lit("coord-"), short_ref(view, subview), F.lit("-"), initials(kind), F.lit("-"), F.substring(F.md5(payload.cast("binary")), 1, 6))
