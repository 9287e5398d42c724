"""References to records that do not exist, by signed counts from change deltas.

Each build of a source adds one to the existence count of every key that it lists and one to the
reference count of every key that it refers to; the source's next build takes both back. The deltas
of a key are put in one order of time and summed up: a key with a positive count of references and
none of existence is an orphan at that moment, and after the last delta in the current report.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalith.functions.names import table_key_col
from catalith.operators.payloads import listed_names
from catalith.operators.rangescan import range_scan
from catalith.session import cut

#: What happens to a key at one moment, in this order: it is known from some first time on (the time of the row is null), its
#: existence changes, it is referred to, references to it are taken back.
FIRST, EXIST, REFER, RELEASE = 0, 1, 2, 3


def spans(builds: DataFrame) -> DataFrame:
    """source, build, at, until of builds(source, build, at): ``until`` is the time of the source's next build, null for its last one. Of builds at one time the larger ``build`` follows."""
    return range_scan(builds, ["source"], [F.col("at").desc(), F.col("build").desc()], {"until": ("lag", "at")})


def signed(listing: DataFrame, span: DataFrame, sign: int = 1) -> DataFrame:
    """key, at, d: +1 where a build lists a key, -1 where the source's next build replaces it, summed by key and time."""
    held = listing.join(span, ["source", "build", "at"])
    plus = held.select("key", "at", F.lit(sign).alias("d"))
    minus = held.filter("until is not null").select("key", F.col("until").alias("at"), F.lit(-sign).alias("d"))
    return plus.unionByName(minus).groupBy("key", "at").agg(F.sum("d").alias("d"))


def orphan_references(refs: DataFrame, listing: DataFrame, builds: DataFrame) -> DataFrame:
    """References whose key doesn't exist at their time, with ``status``: the key has references and no existence then.

    refs: key, at, source and build (null for a reference that no build takes back) and any other columns (none named d, r, first_at,
    kind, exist, held). listing: source, build, at, key, distinct; builds: source, build, at, distinct, also those that list
    nothing. A build holds from its time on, that moment included, until the next build of its source; of builds of one
    source at one time the larger ``build`` follows, and its references are taken back after all of that moment are counted.
    status: ``deleted`` if a build not after the reference lists the key, else ``late`` if a later one does, else
    ``missing``. References without a key or a time have no state and are left out. One key may hold any share of the rows.
    """
    more = [c for c in refs.columns if c not in ("key", "at")]
    none = lambda t: F.lit(None).cast(t)
    blank = [none(refs.schema[c].dataType).alias(c) for c in more]
    span = cut(spans(builds))
    asked = refs.filter("key is not null and at is not null")
    event = lambda df, at, kind, d, r, first, rest: df.select("key", at.cast("timestamp").alias("at"), F.lit(kind).alias("kind"), d.cast("long").alias("d"), r.cast("long").alias("r"), first.cast("timestamp").alias("first_at"), *rest)
    zero, no = F.lit(0), F.lit(None)
    back = asked.filter("build is not null").join(span.filter("until is not null").withColumnRenamed("at", "since").withColumnRenamed("build", "b").withColumnRenamed("source", "s"), (F.col("source") == F.col("s")) & (F.col("build") == F.col("b")) & (F.col("at") == F.col("since")))
    released = back.groupBy("key", "until").agg(F.count("*").alias("n"))
    events = (
        event(listing.groupBy("key").agg(F.min("at").alias("m")), no, FIRST, zero, zero, F.col("m"), blank)
        .unionByName(event(signed(listing, span).filter("d <> 0"), F.col("at"), EXIST, F.col("d"), zero, no, blank))
        .unionByName(event(asked, F.col("at"), REFER, zero, F.lit(1), no, more))
        .unionByName(event(released, F.col("until"), RELEASE, zero, -F.col("n"), no, blank))
    )
    run = range_scan(events, ["key"], [F.col("at").asc_nulls_first(), F.col("kind")], {"exist": ("sum", "d"), "held": ("sum", "r"), "since": ("last", "first_at")})
    status = F.when(F.col("since") <= F.col("at"), "deleted").when(F.col("since").isNotNull(), "late").otherwise("missing")
    return run.filter(F.col("kind") == REFER).filter("exist = 0 and held > 0").select("key", "at", *more, status.alias("status"))


def key_counts(refs: DataFrame, listing: DataFrame, builds: DataFrame) -> DataFrame:
    """key, refs, exist: the signed counts of each key after the last delta, as of now."""
    span = cut(spans(builds))
    exist = signed(listing, span).select("key", F.lit(0).cast("long").alias("refs"), F.col("d").alias("exist"))
    asked = refs.filter("key is not null and at is not null")
    owned = signed(asked.filter("build is not null").select("source", "build", "at", "key"), span).select("key", F.col("d").alias("refs"), F.lit(0).cast("long").alias("exist"))
    free = asked.filter("build is null").groupBy("key").agg(F.count("*").alias("refs")).select("key", "refs", F.lit(0).cast("long").alias("exist"))
    return merge_counts(exist.unionByName(owned).unionByName(free))


def merge_counts(*deltas: DataFrame) -> DataFrame:
    """key, refs, exist: signed counts added up; keys whose counts are both 0 are forgotten. The counts so far and a batch's deltas give the counts after the batch."""
    every = deltas[0]
    for d in deltas[1:]:
        every = every.unionByName(d)
    return every.groupBy("key").agg(F.sum("refs").alias("refs"), F.sum("exist").alias("exist")).filter("refs <> 0 or exist <> 0")


def orphans_now(counts: DataFrame) -> DataFrame:
    """key, refs: the keys with references and without existence."""
    return counts.filter("refs > 0 and exist = 0").select("key", "refs")


def month(at) -> F.Column:
    """YYYY-MM of a time in UTC, whatever the session's zone."""
    return F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM")


def catalog_references(snapshots: DataFrame, hints: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The references, listing and builds (see orphan_references) of snapshots and join hints. Repeated rows give one row; snapshots without a time count for nothing."""
    snaps = snapshots.filter("built_at is not null").select(F.coalesce("source", F.lit("")).alias("source"), F.col("snap_id").alias("build"), F.col("built_at").alias("at"), "payload")
    names = cut(listed_names(snaps, ["source", "build", "at"]).distinct())
    builds = snaps.select("source", "build", "at").distinct()
    listing = names.filter("side = 'table'").select("source", "build", "at", F.col("table_key").alias("key")).distinct()
    edges = names.filter("side <> 'table'").select(F.col("table_key").alias("key"), "at", F.lit("snapshots").alias("ref_table"), F.col("build").cast("long").alias("ref_id"), "pos", "side", "source", "build")
    none = [F.lit(None).cast(snaps.schema[c].dataType).alias(c) for c in ("source", "build")]
    sides = [
        hints.select(table_key_col(F.col(f"{s}_table")).alias("key"), F.col("created_at").alias("at"), F.lit("join_hints").alias("ref_table"), F.col("id").cast("long").alias("ref_id"), F.lit(0).alias("pos"), F.lit(s).alias("side"), *none)
        for s in ("from", "to")
    ]
    return edges.unionByName(sides[0].unionByName(sides[1])).distinct(), listing, builds


def catalog_orphans(snapshots: DataFrame, hints: DataFrame) -> DataFrame:
    """table_key, ref_table, ref_id, pos, side, status, ym of the references of hints and snapshot edges to tables that no source lists at their time."""
    out = orphan_references(*catalog_references(snapshots, hints))
    return out.select(F.col("key").alias("table_key"), "ref_table", "ref_id", "pos", "side", "status", month(F.col("at")).alias("ym")).distinct()


def catalog_orphans_now(snapshots: DataFrame, hints: DataFrame) -> DataFrame:
    """table_key, n_refs, status: the tables that hints or the latest builds' edges name and no latest build lists. ``deleted`` if an earlier build listed them, else ``missing``."""
    refs, listing, builds = catalog_references(snapshots, hints)
    once = listing.select("key").distinct().withColumn("once", F.lit("deleted"))
    return orphans_now(key_counts(refs, listing, builds)).join(once, "key", "left").select(F.col("key").alias("table_key"), F.col("refs").alias("n_refs"), F.coalesce("once", F.lit("missing")).alias("status"))
