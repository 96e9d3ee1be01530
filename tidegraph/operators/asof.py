"""Attributes as known at event time: each event with the version valid and known then.

Versions become usable at the later of valid_from and available_at. Per entity, ordered by that instant, the version
in force is a running maximum of (valid_from, available_at, version_id); versions that become usable at one instant
are resolved first, so a plain as-of join against this current-state list gives the answer. The join runs in DuckDB,
one call for each bucket of entities, inside Arrow-fed workers.

Defined results: events with a null entity or time, and versions with a null entity or time, match nothing; repeated
events or versions change nothing in the distinct result; empty sides give an empty (inner) or null-filled (left)
result; extra columns are carried under their own names only when listed in payload.
"""

from __future__ import annotations


import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.session import cut, task_count


def current_states(versions: DataFrame, entity: str, valid_us: str, known_us: str, tie: str, payload: list[str] | None = None) -> DataFrame:
    """(entity, usable_us, payload...): the version in force from each instant at which it changes.

    One window over the versions of an entity, sorted by instant; equal states in a row are dropped.
    """
    payload = payload or []
    rank = F.struct(F.col(valid_us).alias("v"), F.col(known_us).alias("k"), F.col(tie).alias("i"), *(F.col(c).alias(f"p{n}") for n, c in enumerate(payload)))
    v = versions.filter(F.col(entity).isNotNull() & F.col(valid_us).isNotNull() & F.col(known_us).isNotNull())
    v = v.select(F.col(entity).alias("entity"), F.greatest(valid_us, known_us).alias("usable_us"), rank.alias("rank"))
    v = v.groupBy("entity", "usable_us").agg(F.max("rank").alias("rank"))
    w = Window.partitionBy("entity").orderBy("usable_us")
    v = v.withColumn("best", F.max("rank").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    v = v.withColumn("before", F.lag("best").over(w)).filter(F.col("before").isNull() | (F.col("before") != F.col("best")))
    return v.select("entity", "usable_us", F.col("best.i").alias(tie), *(F.col(f"best.p{n}").alias(c) for n, c in enumerate(payload)))


def _asof(left_cols: list[str], right_cols: list[str]):
    import duckdb

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
        try:
            con.register("ev", left)
            con.register("st", right)
            con.execute("SET preserve_insertion_order = false")
            cols = ", ".join([f'ev."{c}"' for c in left_cols] + [f'st."{c}"' for c in right_cols])
            return con.sql(f"SELECT {cols} FROM ev ASOF LEFT JOIN st ON ev.entity = st.entity AND ev.event_us >= st.usable_us").to_arrow_table()
        finally:
            con.close()

    return run


def asof_join(events: DataFrame, states: DataFrame, keep: list[str], payload: list[str], how: str = "left", rows: int = 250_000) -> DataFrame:
    """Each event (entity, event_us, keep...) with the state (entity, usable_us, payload...) in force at its time.

    Entities are hashed to buckets of about `rows` events. The events of an entity that alone outgrows a bucket are spread
    over as many as its count asks for by a hash of the row, and only its states are repeated there. There are fewer such
    entities than buckets, so their list can be sent to all tasks.
    """
    ev = events.select("entity", "event_us", *keep)
    total = ev.count()
    n = max(task_count(events.sparkSession), -(-total // rows))
    share = max(total // n, 1)
    hot = ev.filter("entity is not null").groupBy("entity").agg(F.count("*").alias("_n")).filter(F.col("_n") > share).select("entity", F.ceil(F.col("_n") / share).cast("int").alias("hot"))
    ev = ev.join(F.broadcast(hot), "entity", "left")
    ev = ev.withColumn("bucket", F.pmod(F.xxhash64("entity", F.coalesce(F.pmod(F.xxhash64("event_us", *keep), F.col("hot")), F.lit(0)).cast("long")), F.lit(n)).cast("int")).drop("hot")
    st = states.join(F.broadcast(hot), "entity", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("hot"), F.lit(1)) - 1)))
    st = st.withColumn("bucket", F.pmod(F.xxhash64("entity", F.col("salt").cast("long")), F.lit(n)).cast("int")).select("bucket", "entity", "usable_us", *payload).distinct()
    fields = {f.name: f.dataType.simpleString() for f in [*ev.schema.fields, *st.schema.fields]}
    ddl = ", ".join(f"`{c}` {fields[c]}" for c in ["entity", "event_us", *keep, *payload])
    fn = _asof(["entity", "event_us", *keep], payload)
    out = ev.groupBy("bucket").cogroup(st.groupBy("bucket")).applyInArrow(lambda key, a, b: fn(key, a, b), ddl)
    return out if how == "left" else out.filter(F.col(payload[0]).isNotNull())


def edges_as_known(edges: DataFrame, reviews: DataFrame, profiles: DataFrame, payload: list[str] | None = None) -> DataFrame:
    """(src, dst, event_us, version_id, payload...): edges available at their dst review's time with the src reviewer's version known then.

    The as-of join is a left join; edges without a version are dropped after it.
    """
    payload = payload or []
    r = reviews.select("review_id", "reviewer_id", F.unix_micros(F.col("timestamp").cast("timestamp")).alias("us"))
    dst = r.filter("us is not null").select(F.col("review_id").alias("dst"), F.col("us").alias("event_us")).distinct()
    src = r.filter("reviewer_id is not null").select(F.col("review_id").alias("src"), F.col("reviewer_id").alias("entity")).distinct()
    e = edges.filter("src is not null and dst is not null and available_at is not null").groupBy("src", "dst").agg(F.min("available_at").alias("available_at"))
    ev = e.join(dst, "dst").filter(F.col("available_at") <= F.floor(F.col("event_us") / 1000000)).join(src, "src").select("entity", "event_us", "src", "dst")
    ev = cut(ev, "asof-events")
    p = profiles.select("reviewer_id", F.unix_micros(F.col("valid_from").cast("timestamp")).alias("valid_us"), (F.col("available_at") * 1000000).alias("known_us"), "version_id", *payload)
    st = current_states(p, "reviewer_id", "valid_us", "known_us", "version_id", payload)
    return asof_join(ev, st, ["src", "dst"], ["version_id", *payload], how="inner")
