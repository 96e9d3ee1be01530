"""Loading raw feeds: rows that fail to parse come out with the reason, the rest load.

Physical lines become records first (records()): where a feed allows line breaks inside quotes, an open quote is carried
to the line that closes it. Records are parsed per partition with Python's strict csv reader and a strict JSON decoder;
structural exceptions are caught before any typed field is built. The parsed table is written once; duplicates are found
over its fingerprints of parsed values.

Defined results: an empty feed gives empty outputs; a null or blank line is neither loaded nor reported; a line of an
unknown or null format is parsed by its look (a leading brace: JSON, else CSV); ties of source_row inside one file are
ordered by a hash of the raw line; extra columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import csv
import hashlib
import json
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.session import cut

#: Field order of a CSV line, reasons in the order in which they apply, plausible epoch milliseconds.
FIELDS = ("user_id", "parent_asin", "asin", "title", "text", "rating", "timestamp", "verified_purchase")
REASONS = ("malformed_record", "not_an_object", "wrong_column_count", "missing_required_ids", "missing_timestamp", "rating_out_of_range", "exact_duplicate", "implausible_timestamp")
FIRST_MS, LAST_MS = 788918400000, 2051222400000

_CSV_SHAPE = re.compile(r'(?:"(?:[^"]|"")*"|[^",]*)(?:,(?:"(?:[^"]|"")*"|[^",]*))*')
_DECIMAL = re.compile(r"[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)")
_WHOLE = re.compile(r"[+-]?[0-9]{1,19}")

_PARSED = pa.schema(
    [
        ("source_file", pa.string()),
        ("source_row", pa.int64()),
        ("reason", pa.string()),
        ("fingerprint", pa.binary()),
        ("user_id", pa.string()),
        ("parent_asin", pa.string()),
        ("asin", pa.string()),
        ("title", pa.string()),
        ("text", pa.string()),
        ("rating", pa.float64()),
        ("timestamp_ms", pa.int64()),
        ("verified_purchase", pa.bool_()),
        ("raw", pa.string()),
    ]
)
PARSED_DDL = "source_file string, source_row bigint, reason string, fingerprint binary, user_id string, parent_asin string, asin string, title string, text string, rating double, timestamp_ms bigint, verified_purchase boolean, raw string"


class _Exponent(float):
    """A JSON number written with an exponent; it is no plain decimal."""


class _Malformed(ValueError):
    pass


def _refuse(token: str) -> None:
    raise _Malformed(token)


def _number(token: str) -> float:
    return _Exponent(token) if "e" in token or "E" in token else float(token)


def _integer(token: str) -> int | float:
    return int(token) if len(token) < 40 else float(token)


_decoder = json.JSONDecoder(parse_constant=_refuse, parse_float=_number, parse_int=_integer)


def assemble(lines: Iterator[str]) -> Iterator[str]:
    """Join physical lines to records: a line break inside an open quote belongs to the record.

    One pass over the lines of one file in order; a quote still open at the end leaves the rest as one last record.
    """
    held: list[str] = []
    odd = False
    for line in lines:
        held.append(line)
        odd ^= line.count('"') % 2 == 1
        if not odd:
            yield "\n".join(held)
            held = []
    if held:
        yield "\n".join(held)


def parse_csv(record: str) -> list[str]:
    """Fields of one CSV record by the strict reader; raises where RFC 4180 is broken."""
    try:
        rows = list(csv.reader(record.splitlines(True) if "\n" in record or "\r" in record else [record], strict=True))
    except csv.Error as e:
        raise _Malformed(str(e)) from None
    if len(rows) != 1 or ('"' in record and not _CSV_SHAPE.fullmatch(record)):
        raise _Malformed("quote or line break outside a quoted field")
    return rows[0]


def _blank(v: object) -> bool:
    return v is None or (isinstance(v, str) and not v.strip())


def _text(v: object) -> str | None:
    if v is None:
        return None
    s = v if isinstance(v, str) else json.dumps(v, sort_keys=True, ensure_ascii=False)
    return s.encode("utf-8", "replace").decode("utf-8")


def _rating(v: object) -> float | None:
    if isinstance(v, (bool, _Exponent)):
        return None
    if isinstance(v, (int, float)):
        x = float(v)
    elif isinstance(v, str) and _DECIMAL.fullmatch(v.strip()):
        x = float(v)
    else:
        return None
    return x if 1 <= x <= 5 else None


def _millis(v: object) -> int | None:
    if isinstance(v, bool):
        return None
    if isinstance(v, float):
        v = int(v) if v == v and abs(v) < 1e18 and v == int(v) else None
    elif isinstance(v, str):
        v = int(v) if _WHOLE.fullmatch(v.strip()) else None
    return v if isinstance(v, int) and FIRST_MS <= v <= LAST_MS else None


def _same_time(v: object) -> str:
    """Timestamps as compared between records: numbers by value, anything else by its text."""
    if isinstance(v, str) and _WHOLE.fullmatch(v.strip()):
        v = int(v)
    if isinstance(v, float) and abs(v) < 1e18 and v == int(v):
        v = int(v)
    return f"{type(v).__name__}:{v}"


def parse_line(fmt: str | None, raw: str) -> tuple[str | None, dict]:
    """The first structural or field reason that applies to a line (None: it came as far as the duplicate check), and its fields."""
    line = raw.rstrip("\r\n")
    as_json = fmt == "jsonl" or (fmt != "csv" and line.lstrip().startswith("{"))
    if as_json:
        try:
            if line != (body := line.strip(" \t\r\n")) and not body:
                raise _Malformed("blank")
            got, end = _decoder.raw_decode(body)
            if end != len(body):
                raise _Malformed("characters after the value")
        except (ValueError, RecursionError):
            return "malformed_record", {}
        if not isinstance(got, dict):
            return "not_an_object", {}
    else:
        try:
            values = parse_csv(line)
        except _Malformed:
            return "malformed_record", {}
        if len(values) != len(FIELDS):
            return "wrong_column_count", {}
        got = dict(zip(FIELDS, values))
    if _blank(got.get("user_id")) or _blank(got.get("parent_asin")):
        return "missing_required_ids", got
    if _blank(got.get("timestamp")):
        return "missing_timestamp", got
    if _rating(got.get("rating")) is None:
        return "rating_out_of_range", got
    return None, got


def _fingerprint(got: dict) -> bytes:
    asin = got.get("asin")
    parts = [_text(got.get("user_id")), _text(got.get("parent_asin")), _text(asin) if asin not in (None, "") else "", _same_time(got.get("timestamp")), repr(_rating(got.get("rating"))), _text(got.get("text")), _text(got.get("title"))]
    return hashlib.sha256(json.dumps(parts).encode()).digest()


def _flag(v: object) -> bool | None:
    return v if isinstance(v, bool) else {"true": True, "false": False}.get(str(v).strip().lower()) if v is not None else None


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    csv.field_size_limit(sys.maxsize)
    for batch in batches:
        rows: list[tuple] = []
        for file, row, fmt, raw in zip(*(c.to_pylist() for c in batch.columns)):
            if raw is None or not raw.strip():
                continue
            reason, got = parse_line(fmt, raw)
            if reason:
                rows.append((file, row, reason, *[None] * 9, raw))
            else:
                asin = _text(got.get("asin"))
                rows.append((file, row, None if _millis(got["timestamp"]) is not None else "implausible_timestamp", _fingerprint(got), _text(got["user_id"]), _text(got["parent_asin"]), asin or None, _text(got.get("title")), _text(got.get("text")), _rating(got["rating"]), _millis(got["timestamp"]), _flag(got.get("verified_purchase")), raw))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(_PARSED), _PARSED)], schema=_PARSED)


def records(feed: DataFrame, line_breaks: bool = False, most_lines: int = 1000) -> DataFrame:
    """Lines (source_file, source_row, format, raw) as records.

    Without line_breaks, as in a feed that declares none, each line is a record. With them, a CSV line with an odd number
    of quotes opens a record that ends with the file's next such line, at most most_lines below; if the joined lines
    parse they are one record under the first line's number, else each stays a record of its own. Only lines with an odd
    number of quotes are sorted, by file; the lines between are found by a join.
    """
    feed = feed.select("source_file", "source_row", "format", "raw")
    if not line_breaks:
        return feed
    odd = feed.filter((F.col("format") == "csv") & (F.length("raw") - F.length(F.replace("raw", F.lit('"'), F.lit("")))).bitwiseAND(1).cast("boolean"))
    w = Window.partitionBy("source_file").orderBy("source_row")
    spans = odd.select("source_file", F.col("source_row").alias("a"), F.lead("source_row").over(w).alias("b")).filter(F.col("b") - F.col("a") <= most_lines)
    lines = feed.filter("raw is not null").alias("f").join(spans.alias("s"), (F.col("f.source_file") == F.col("s.source_file")) & F.col("source_row").between(F.col("a"), F.col("b")))
    joined = lines.groupBy("s.source_file", "a", "b").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("source_row", "raw"))), lambda x: x["raw"]), "\n").alias("raw"))
    whole = cut(joined.mapInArrow(_whole, "source_file string, a bigint, b bigint, raw string"), "spanning")
    # a line may close one span and open the next; the earlier one counts
    whole = whole.withColumn("before", F.lag("b").over(Window.partitionBy("source_file").orderBy("a"))).filter("before is null or before < a").drop("before")
    used = whole.select("source_file", F.explode(F.sequence("a", "b")).alias("source_row"))
    return feed.join(used, ["source_file", "source_row"], "left_anti").select(feed.columns).unionByName(whole.select("source_file", F.col("a").alias("source_row"), F.lit("csv").alias("format"), "raw"))


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The spans whose lines, put together by assemble(), are one record that parses."""
    csv.field_size_limit(sys.maxsize)
    for batch in batches:
        keep = []
        for i, raw in enumerate(batch.column(3).to_pylist()):
            got = list(assemble(iter(raw.split("\n"))))
            if len(got) == 1 and parse_line("csv", got[0])[0] is None:
                keep.append(i)
        yield batch.take(pa.array(keep, pa.int64()))


def parse_feed(feed: DataFrame, line_breaks: bool = False) -> DataFrame:
    """Every non-blank record of a feed (source_file, source_row, format, raw) with its reason or its typed fields; no shuffle where each line is a record."""
    return records(feed, line_breaks).mapInArrow(_parse_batches, PARSED_DDL)


def classify_feed(feed: DataFrame, line_breaks: bool = False, share: int = 200_000) -> DataFrame:
    """parse_feed() with exact_duplicate set; reason is null for the lines that load.

    The feed is parsed once. The first line of each (source_file, fingerprint) is a min() with map-side combine; only
    fingerprints that occur twice are joined back. If one of them has more than `share` lines, both sides are salted by its
    count, so that a record repeated over a third of a feed stays spread out.
    """
    parsed = cut(parse_feed(feed, line_breaks).withColumn("_rank", F.struct("source_row", F.xxhash64("raw"))), "parsed")
    first = parsed.filter("fingerprint is not null").groupBy("source_file", "fingerprint").agg(F.min("_rank").alias("_first"), F.count("*").alias("_n")).filter("_n > 1")
    first = cut(first, "repeated")
    most = first.agg(F.max("_n").alias("n")).first().n or 1
    salts = -(-most // share)
    f = first.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).alias("f")
    rows = parsed.filter("fingerprint is not null").withColumn("_salt", F.pmod(F.xxhash64("_rank"), F.lit(salts)).cast("int")).alias("r")
    joined = rows.join(f, F.col("r.source_file").eqNullSafe(F.col("f.source_file")) & (F.col("r.fingerprint") == F.col("f.fingerprint")) & (F.col("r._salt") == F.col("f._salt")), "left")
    later = F.col("f._first").isNotNull() & (F.col("r._rank") > F.col("f._first"))
    names = ["source_file", "source_row", "reason", *(c for c in FIELDS if c not in ("timestamp", "verified_purchase")), "timestamp_ms", "verified_purchase", "raw"]
    judged = joined.withColumn("_reason", F.when(later, "exact_duplicate").otherwise(F.col("r.reason"))).select(*(F.col("_reason").alias("reason") if c == "reason" else F.col(f"r.{c}") for c in names))
    return judged.unionByName(parsed.filter("fingerprint is null").select(*names))


def rejected_lines(feed: DataFrame) -> DataFrame:
    """source_file, source_row, reason of each non-blank line that does not load."""
    return classify_feed(feed).filter("reason is not null").select("source_file", "source_row", "reason").distinct()


def accepted_reviews(feed: DataFrame, source: str = "mk", hashes: DataFrame | None = None, unit: str = "ms") -> DataFrame:
    """The lines that load, as canonical reviews; a blank text becomes null with text_missing.

    hashes: (source_file, source_file_hash), one row a file; without them the hash of the file's name stands in. Ids are
    derived from source, file hash and row. unit: "ms" or "s", the resolution in which times are kept.
    """
    ok = classify_feed(feed).filter("reason is null")
    if hashes is None:
        ok = ok.withColumn("source_file_hash", F.sha2("source_file", 256))
    else:
        ok = ok.join(F.broadcast(hashes.select("source_file", "source_file_hash")), "source_file", "left")
    blank = F.trim(F.coalesce("text", F.lit(""))) == ""
    rid = F.concat(F.lit(f"{source}:"), F.substring(F.sha2(F.concat_ws("|", F.lit(source), "source_file_hash", F.col("source_row").cast("string")), 256), 1, 16))
    return ok.select(
        rid.alias("review_id"),
        F.concat(F.lit(f"{source}:"), "user_id").alias("reviewer_id"),
        F.concat(F.lit(f"{source}:"), "parent_asin").alias("target_id"),
        F.when(F.col("asin").isNotNull(), F.concat(F.lit(f"{source}:"), "asin")).alias("variant_id"),
        (F.timestamp_millis("timestamp_ms") if unit == "ms" else F.timestamp_seconds(F.floor(F.col("timestamp_ms") / 1000))).alias("timestamp"),
        "title",
        F.when(~blank, F.col("text")).alias("text"),
        "rating",
        F.col("source_file").alias("source"),
        "source_row",
        "source_file_hash",
        "verified_purchase",
        blank.alias("text_missing"),
    )


def quarantine(feed: DataFrame) -> DataFrame:
    """Rejected lines whole, with their reason."""
    return classify_feed(feed).filter("reason is not null").select("source_file", "source_row", "reason", "raw")


def audit(feed: DataFrame) -> DataFrame:
    """Per file: read, accepted, duplicates and rejected lines, and the reasons as a map; read = accepted + duplicates + rejected."""
    counts = classify_feed(feed).groupBy("source_file", "reason").agg(F.count("*").alias("n"))
    n = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("long")
    pairs = F.collect_list(F.when(F.col("reason").isNotNull(), F.struct("reason", "n")))
    return counts.groupBy("source_file").agg(
        n(F.lit(True)).alias("read_rows"),
        n(F.col("reason").isNull()).alias("accepted"),
        n(F.col("reason") == "exact_duplicate").alias("duplicates"),
        n(F.col("reason").isNotNull() & (F.col("reason") != "exact_duplicate")).alias("rejected"),
        F.map_from_entries(F.array_sort(pairs)).alias("reasons"),
    )


def reconcile(feed: DataFrame, earlier: DataFrame) -> DataFrame:
    """The audit over whole files beside an earlier loader's, which stopped at last_source_row and passed over malformed lines.

    Lines up to that row are counted the same way as the earlier loader did (malformed ones left out); reconciled is
    true where its four counters and every entry of its reasons agree (a count of 0 equals an absent one). Files of the
    feed without audit and audited files without a line in the feed come out too, not reconciled unless all is 0.
    """
    names = ("read_rows", "accepted", "duplicates", "rejected")
    e = earlier.groupBy("source_file").agg(*(F.max(c).alias(f"e_{c}") for c in ("last_source_row", *names)), F.first("reasons", ignorenulls=True).alias("e_reasons"))
    lines = classify_feed(feed).select("source_file", "source_row", "reason").join(e.select("source_file", "e_last_source_row"), "source_file", "left")
    seen = (F.col("source_row") <= F.col("e_last_source_row")) & ~F.coalesce(F.col("reason") == "malformed_record", F.lit(False))
    counts = lines.groupBy("source_file", "reason").agg(F.count("*").alias("n"), F.count_if(seen).alias("s"))
    dup = F.coalesce(F.col("reason") == "exact_duplicate", F.lit(False))
    conds = dict(zip(names, (F.lit(True), F.col("reason").isNull(), dup, F.col("reason").isNotNull() & ~dup)))
    tally = lambda x, cond: F.sum(F.when(cond, F.col(x)).otherwise(0)).cast("long")
    entries = lambda x: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("reason").isNotNull() & (F.col(x) > 0), F.struct("reason", x)))))
    c = counts.groupBy("source_file").agg(*(tally("n", k).alias(f"n_{x}") for x, k in conds.items()), *(tally("s", k).alias(f"s_{x}") for x, k in conds.items()), entries("n").alias("n_reasons"), entries("s").alias("s_reasons"))
    out = c.withColumnRenamed("source_file", "f").join(e, F.col("f").eqNullSafe(F.col("source_file")), "full_outer").withColumn("source_file", F.coalesce("f", "source_file"))
    zero = lambda x: F.coalesce(x, F.lit(0).cast("long"))
    none = F.from_json(F.lit("{}"), "map<string,bigint>")
    full = lambda m: F.array_sort(F.map_entries(F.map_filter(F.coalesce(m, none), lambda _, v: v != 0)))
    same = full("s_reasons") == full("e_reasons")
    for x in names:
        same &= zero(f"s_{x}") == F.col(f"e_{x}")
    return out.select(
        "source_file",
        *(zero(f"n_{x}").alias(x) for x in names),
        F.coalesce("n_reasons", none).alias("reasons"),
        F.col("e_last_source_row").alias("last_source_row"),
        zero("s_read_rows").alias("earlier_scope_read"),
        F.col("e_read_rows").alias("earlier_read"),
        F.coalesce("s_reasons", none).alias("earlier_scope_reasons"),
        F.col("e_reasons").alias("earlier_reasons"),
        F.coalesce(same, F.lit(False)).alias("reconciled"),
    )
