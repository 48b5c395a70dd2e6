"""Document fingerprints: bottom-k sketches of shingle hashes, with DataFrame functions only.

A sketch is the sorted array of the `K` least 64-bit hashes of a text's distinct five-word shingles (of all words, if there are fewer). Sketches of parts merge into the sketch of the whole; two
of them estimate resemblance and containment, one the number of distinct shingles. With fewer shingles than K all are exact.
The standard error of a resemblance is at most 0.5 / sqrt(K).

Nulls: a null text is the empty text, whose sketch is empty; two empty sketches resemble each other fully, an empty and
a full one not at all. In `with_next`, rows without id come first, rows with equal ids are ordered by text, and equal
rows are interchangeable. Empty tables give empty results; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, SHINGLE = 128, 5
BUCKET_ROWS, MOST_BUCKETS = 500, 16384


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often it's used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def sketch(text: Column, k: int = K, shingle: int = SHINGLE) -> Column:
    """The bottom-k sketch of a text."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x09-\x0D\x20]+"), lambda w: w != "")
    hashes = let(
        words,
        lambda w: F.when(F.size(w) == 0, F.array().cast("array<bigint>"))
        .when(F.size(w) < shingle, F.array(F.xxhash64(w)))
        .otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (shingle - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, F.lit(shingle))))),
    )
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_all(rows: DataFrame, key: str, column: str, k: int = K, salts: int = 64) -> DataFrame:
    """One sketch a key: (key, column). Hashes are ranked within salted parts of a key first, so that a hot key needs no
    task of its own; at most `salts` x k hashes of a key meet."""
    each = rows.select(F.col(key).alias("_key"), F.explode(F.col(column)).alias("_hash")).distinct()
    for by in (["_key", F.pmod(F.col("_hash"), F.lit(salts))], ["_key"]):
        each = each.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy("_hash"))).where(F.col("_rank") <= k).select("_key", "_hash")
    some = each.groupBy("_key").agg(F.sort_array(F.collect_list("_hash")).alias("_sketch"))
    keys = rows.select(F.col(key).alias("_key")).distinct()
    return keys.join(some, keys["_key"].eqNullSafe(some["_key"]), "left").select(
        keys["_key"].alias(key), F.coalesce("_sketch", F.array().cast("array<bigint>")).alias(column)
    )


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """The estimated Jaccard similarity, from 0 to 1."""
    return let(
        merge(a, b, k),
        lambda u: F.when(F.size(u) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(F.array_intersect(u, a), b)) / F.size(u)),
    )


def distinct_count(a: Column, k: int = K) -> Column:
    """The estimated number of distinct shingles; exact below k."""
    place = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(k - 1) / place)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """The estimated share of a's shingles that b has too, from 0 to 1; 1 for an empty a."""
    j = resemblance(a, b, k)
    shared = j / (1 + j) * (distinct_count(a, k) + distinct_count(b, k))
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), shared / distinct_count(a, k)))


def to_string(a: Column) -> Column:
    """A sketch as base64 of its big-endian hashes."""
    return F.base64(F.unhex(F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), 16, "0")), "")))


def _bucket(id_: Column, splits: list[int]) -> Column:
    """How many of the ascending splits are at most id; by binary search."""
    if not splits:
        return F.lit(0)
    steps = [1 << i for i in range(len(splits).bit_length() - 1, -1, -1)]
    found = F.aggregate(
        F.lit(steps),
        F.lit(0),
        lambda at, s: F.when((at + s <= len(splits)) & (F.get(F.lit(splits), at + s - 1) <= id_), at + s).otherwise(at),
    )
    return F.coalesce(found, F.lit(0))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """(doc_id, text, sketch, next_text, next_sketch): the next document in ascending order of id, after the last the first.

    Ids are split at their approximate quantiles into buckets of about `BUCKET_ROWS`, at most `MOST_BUCKETS`; a window
    over each finds the next row. Each bucket also gets a copy of the next bucket's first row, which stands last. Texts are
    shuffled once; no window spans the table.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = slim.count()
    buckets = max(1, min(MOST_BUCKETS, n // BUCKET_ROWS))
    splits: list[int] = []
    if buckets > 1:
        at = [i / buckets for i in range(1, buckets)]
        splits = sorted({*(slim.select(F.percentile_approx("doc_id", at, 10 * buckets).alias("x")).first()["x"] or [])})
    base = slim.withColumn("bucket", _bucket(F.col("doc_id"), splits))
    lows = base.groupBy("bucket").agg(F.min(F.struct("doc_id")).alias("low")).select("bucket", "low.doc_id")
    firsts = sorted((r["bucket"], r["doc_id"]) for r in lows.collect())  # at most MOST_BUCKETS numbers
    if not firsts:
        return slim.select("*", sketch(F.col("text"), k).alias("sketch"), F.lit("").alias("next_text"), F.array().cast("array<bigint>").alias("next_sketch"))
    # the first row of bucket i goes to the end of the bucket before
    ends = [(firsts[i - 1][0], firsts[i][1]) for i in range(len(firsts))]
    wanted = docs.sparkSession.createDataFrame(ends, "bucket int, doc_id long")
    copies = (
        slim.join(F.broadcast(wanted.withColumnRenamed("doc_id", "first_id")), F.col("doc_id").eqNullSafe(F.col("first_id")))
        .groupBy("bucket")
        .agg(F.min(F.struct("doc_id", "text")).alias("row"))
        .select("row.doc_id", "row.text", "bucket", F.lit(1).alias("copy"))
    )
    rows = base.withColumn("copy", F.lit(0)).unionByName(copies).withColumn("sketch", sketch(F.col("text"), k))
    order = Window.partitionBy("bucket").orderBy("copy", "doc_id", "text")
    after = rows.select("doc_id", "text", "sketch", "copy", F.lead(F.struct("text", "sketch")).over(order).alias("next"))
    return after.where("copy = 0").select("doc_id", "text", "sketch", F.col("next.text").alias("next_text"), F.col("next.sketch").alias("next_sketch"))


def with_edits(docs: DataFrame, k: int = K) -> DataFrame:
    """`with_next` and the edited text: its last quarter replaced by as much of the next document's beginning."""
    n = F.char_length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - quarter), F.substr("next_text", F.lit(1), quarter))
    rows = with_next(docs, k=k).withColumn("edited", edited)
    return rows.withColumn("edited_sketch", sketch(F.col("edited"), k))


def digest(docs: DataFrame, k: int = K) -> DataFrame:
    rows = with_edits(docs, k)
    return rows.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        to_string(F.col("sketch")).alias("fingerprint"),
        to_string(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"),
        distinct_count(F.col("sketch"), k).alias("n_shingles"),
        containment(F.col("sketch"), F.col("edited_sketch"), k).alias("kept_share"),
    )
