"""Sinks: run folders, tables, JSON, evidence cards, weights, an embedding cache, and the data and text of reports.

Tables are written by the tasks; what the driver writes itself (JSON, Markdown, weights) is bounded by the number of
stages, metrics or weights. A folder that holds something is never written into.
"""

from __future__ import annotations

import json
import shutil
from collections.abc import Callable
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def run_directory(path: str) -> str:
    """The folder, made now; raises if it exists and isn't empty."""
    p = Path(path)
    if p.exists() and any(p.iterdir()):
        raise FileExistsError(f"{path} isn't empty")
    p.mkdir(parents=True, exist_ok=True)
    return path


def write_table(df: DataFrame, path: str, *partition_by: str) -> DataFrame:
    """df as a Parquet table (arrays stay array columns), read back; raises if the path exists."""
    df.write.mode("errorifexists").partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.parquet(path)


def write_json(value: object, path: str) -> None:
    """Pretty JSON with sorted keys."""
    Path(path).write_text(json.dumps(value, indent=2, sort_keys=True, default=str, ensure_ascii=False) + "\n")


def stable_json(value: object) -> str:
    """Canonical JSON: sorted keys, no blanks."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def stage_manifest(folder: str, stage: str, **facts: object) -> dict:
    """Write <stage>_manifest.json with the stage, the time and the facts."""
    got = {"stage": stage, "written_at": datetime.now(timezone.utc).isoformat(), **facts}
    write_json(got, f"{folder}/{stage}_manifest.json")
    return got


def write_cards(cards: DataFrame, path: str) -> None:
    """Cards as JSON lines, in place of what was there."""
    cards.write.mode("overwrite").json(path)


def upsert_cards(cards: DataFrame, path: str, key: str = "candidate_id") -> DataFrame:
    """Cards written before, with those of equal key replaced and new ones added; written beside the old and then put in its place."""
    spark = cards.sparkSession
    if Path(path).exists():
        old = spark.read.schema(cards.schema).json(path)
        cards = old.join(cards.select(key).distinct(), key, "left_anti").select(cards.columns).unionByName(cards)
    fresh = f"{path}.new"
    cards.write.mode("overwrite").json(fresh)
    shutil.rmtree(path, ignore_errors=True)
    shutil.move(fresh, path)
    return spark.read.schema(cards.schema).json(path)


def save_weights(weights: dict, path: str) -> None:
    """Arrays by name as JSON, with full precision."""
    Path(path).write_text(json.dumps({k: getattr(v, "tolist", lambda v=v: v)() for k, v in sorted(weights.items())}))


def cached_vectors(texts: DataFrame, cache: str, encoder: str, revision: str, encode: Callable[[DataFrame], DataFrame], prep: str = "1") -> DataFrame:
    """(key, vector) of each distinct text (column text): vectors found in the cache table are read, the rest is encoded once and added.

    The key hashes encoder, revision, preparation and text, so a changed text or encoder is a new entry. encode takes
    (key, text) and gives (key, vector).
    """
    spark = texts.sparkSession
    key = F.sha2(F.concat_ws("|", F.lit(encoder), F.lit(revision), F.lit(prep), F.sha2(F.coalesce("text", F.lit("")), 256)), 256)
    want = texts.select(key.alias("key"), F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["key"])
    missing = want.join(spark.read.parquet(cache).select("key"), "key", "left_anti") if Path(cache).exists() else want
    encode(missing).select("key", F.col("vector").cast("array<float>").alias("vector")).write.mode("append").parquet(cache)
    return spark.read.parquet(cache).join(want.select("key"), "key", "left_semi")


# -- reports ---------------------------------------------------------------------------------------------------------


def markdown_table(names: list[str], rows: list[tuple]) -> str:
    """A Markdown table; missing values are a dash, fractions have four digits."""
    text = lambda v: "-" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    return "\n".join("| " + " | ".join(map(text, r)) + " |" for r in [tuple(names), ("---",) * len(names), *rows])


def write_report(path: str, title: str, sections: dict[str, DataFrame], most: int = 200) -> str:
    """A Markdown report with a table for each section, of at most `most` rows (the sections are summaries)."""
    parts = [f"# {title}"]
    for name, df in sections.items():
        rows = df.limit(most).collect()
        parts.append(f"## {name}\n\n" + (markdown_table(df.columns, [tuple(r) for r in rows]) if rows else "Nothing to report."))
    out = "\n\n".join(parts) + "\n"
    Path(path).write_text(out)
    return out


def figure_data(curve: DataFrame, daily: DataFrame, gates: DataFrame, epochs: DataFrame) -> DataFrame:
    """(figure, series, x, y): the points of the four figures; drawing them is left to the reader's tool."""
    pick = lambda df, figure, series, x, y: df.select(F.lit(figure).alias("figure"), (F.lit(series) if isinstance(series, str) else series).alias("series"), F.col(x).cast("string").alias("x"), F.col(y).cast("double").alias("y"))
    out = pick(curve, "precision_recall", "precision", "recall", "precision").unionByName(pick(daily, "alerts_by_day", "alerts", "day", "alerts"))
    return out.unionByName(pick(gates, "gate_weights", "mean", "expert", "mean_weight")).unionByName(pick(epochs, "validation_ap", F.col("model"), "epoch", "average_precision"))
