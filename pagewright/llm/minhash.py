"""Near-duplicates: circulant MinHash, banding, exact Jaccard verification.

Two permutations make every signature coordinate: the first, sigma, shuffles the shingles' 32-bit places once; coordinate k is the
least value of the second, pi, over those places shifted circularly by k. One byte of each minimum is kept (b-bit minwise), six
bytes make a band, 40 bands a signature. A pair at Jaccard 0.8 misses all bands with probability 5e-6.

How links are found without emitting a group's pairs:

1. Documents with equal shingle sets become one representative (an aggregate that combines before the shuffle).
2. Representatives that share a band meet in its bucket. Buckets larger than `CELL` are dealt out as pairs of blocks, so
   that no task holds a hot bucket. In a cell, signatures are compared and a spanning forest of the pairs that look
   alike (`LOOSE`, over five standard deviations below the threshold) is kept, not the pairs.
3. The components of these forests are candidate groups: any two linked documents are in one. Full shingle sets of a
   group meet once, again in pairs of blocks where a group is large, and Jaccard is computed exactly; each cell gives a
   spanning forest of its links.
4. Components of the links, and of the copies from 1, are the result.

Nulls: a null or blank text has no shingles and is linked with nothing; a row without doc_id neither: its component is
null, and `drop_near_duplicates` leaves it. Rows that repeat a doc_id are judged one by one, and stay or go together.
Empty tables give empty results. The result has its own four columns, whatever else the table holds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, connected_components, drop_durable, durable
from .wordhash import SPACED, chunks, grams

M, M32 = np.uint64, np.uint32
ROWS, BANDS = 6, 40
COORDS = ROWS * BANDS
CELL = 1024
LOOSE = 0.66
HEAVY = 2_000_000


def sigma(shingles: np.ndarray) -> np.ndarray:
    """Shingles' places after the first permutation."""
    x = (shingles >> M(32)).astype(M32)
    x ^= x >> M32(16)
    x *= M32(0x7FEB352D)
    x ^= x >> M32(15)
    x *= M32(0x846CA68B)
    x ^= x >> M32(16)
    return x


def pi(places: np.ndarray) -> np.ndarray:
    """The second permutation of 32-bit places."""
    x = places ^ (places >> M32(15))
    x *= M32(0xD168AAAD)
    x ^= x >> M32(15)
    x *= M32(0xAF723597)
    x ^= x >> M32(16)
    return x


def signatures(places: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """COORDS bytes for each run of places from starts[i] on; no run is empty."""
    out = np.empty((len(starts), COORDS), np.uint8)
    for k in range(COORDS):
        low = np.minimum.reduceat(pi(places - M32(k)), starts)
        out[:, k] = (low * M32(0x9E3779B1)) >> M32(24)
    return out


def shingle_sets(words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct hashes of all texts one after the other, offsets)."""
    hashes = words.hashes()
    sizes = np.diff(words.first)
    owner = words.owner()
    full = np.repeat(sizes >= k, sizes)
    left = words.first[1:][owner] - np.arange(len(owner))  # words from here to the text's end
    g = grams(hashes, k)
    at = np.flatnonzero((full & (left >= k))[: len(g)])
    values, owners = [g[at]], [owner[at]]
    for d in np.flatnonzero((sizes > 0) & (sizes < k)):
        a, b = words.first[d], words.first[d + 1]
        values.append(grams(hashes[a:b], b - a) ^ M(b - a))
        owners.append(np.array([d]))
    value, whose = np.concatenate(values), np.concatenate(owners)
    order = np.lexsort((value, whose))
    value, whose = value[order], whose[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (whose[1:] != whose[:-1])
    value, whose = value[new], whose[new]
    return value, np.searchsorted(whose, np.arange(len(sizes) + 1))


def _signed_step(k: int):
    """doc_id, text -> doc_id, n_shingles, set_key, signature."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for i, j, words in chunks(batch.column(1), SPACED):
                value, offsets = shingle_sets(words, k)
                some = np.flatnonzero(np.diff(offsets))
                keys: list = [None] * (j - i)
                signs: list = [None] * (j - i)
                if len(some):
                    raw = memoryview(value).cast("B")
                    for d, s in zip(some, signatures(sigma(value), offsets[:-1][some]), strict=True):
                        keys[d] = hashlib.blake2b(raw[8 * offsets[d] : 8 * offsets[d + 1]], digest_size=16).digest()
                        signs[d] = s.tobytes()
                columns = [ids.slice(i, j - i), pa.array(np.diff(offsets).astype(np.int64)), pa.array(keys, pa.binary()), pa.array(signs, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "set_key", "signature"])

    return step


def _sets_step(k: int):
    """id, text, set_key, key -> id, key, n_shingles, shingles, where the text's set is the one of that set_key."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(2).to_pylist()
            for i, j, words in chunks(batch.column(1), SPACED):
                value, offsets = shingle_sets(words, k)
                raw = value.tobytes()
                sets = [raw[8 * offsets[d] : 8 * offsets[d + 1]] for d in range(j - i)]
                same = pa.array([hashlib.blake2b(x, digest_size=16).digest() == key for x, key in zip(sets, keys[i:j], strict=True)])
                columns = [batch.column(0).slice(i, j - i), batch.column(3).slice(i, j - i), pa.array(np.diff(offsets).astype(np.int64)), pa.array(sets, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "group", "n_shingles", "shingles"]).filter(same)

    return step


# --- cells -----------------------------------------------------------------------------------------------------------


def dealt(members: DataFrame, key: str, weight: str, cell: int = CELL, heavy: int = HEAVY) -> DataFrame:
    """Members of groups of two and more, with the `cell` they go to: the group, or for one of over `cell` members or
    `heavy` weight each pair of its blocks."""
    sizes = members.groupBy(key).agg(F.count(F.lit(1)).alias("size"), F.sum(weight).alias("heft")).where("size > 1")
    sizes = sizes.withColumn(
        "blocks", F.when((F.col("size") <= cell) & (F.col("heft") <= heavy), 1).otherwise(F.ceil(F.greatest(F.col("size") / F.lit(cell // 2), F.col("heft") / F.lit(heavy // 2)))).cast("int")
    ).select(key, "blocks")
    own = F.when(F.col("blocks") == 1, 0).otherwise(F.pmod(F.xxhash64("id"), F.col("blocks"))).cast("int")
    return (
        members.join(sizes, key)
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("cell", F.xxhash64(F.col(key), F.least("own", "other"), F.greatest("own", "other")))
        .drop("blocks", "own", "other")
    )


def _by_cell(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Whole cells, many small ones at a time, from batches sorted by key."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        if held and held[-1].column(key)[-1].as_py() != keys[0]:
            yield pa.Table.from_batches(held)
            held = []
        cut = int(np.searchsorted(keys, keys[-1], "left")) if (keys[1:] >= keys[:-1]).all() else 0
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def _forest(n: int, near) -> Iterator[tuple[int, int]]:
    """Edges of a spanning forest; near(i, others) says which of the others i is linked with. Members already reached
    are never compared again."""
    rest = np.arange(n)
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        root = queue[0]
        while queue and len(rest):
            found = near(queue.pop(), rest)
            for j in rest[found]:
                queue.append(j)
                yield root, j
            rest = rest[~found]


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return starts, np.r_[starts[1:], len(keys)]


def _pairs(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of rows inside short runs."""
    left, right = [], []
    sizes = ends - starts
    for n in np.unique(sizes):
        i, j = np.triu_indices(n, 1)
        s = starts[sizes == n][:, None]
        left.append((s + i).ravel())
        right.append((s + j).ravel())
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64),) * 2


def _edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _alike_step(least: int):
    def step(batches):
        for rows in _by_cell(batches, "cell"):
            ids = rows.column("id").to_numpy()
            signs = np.frombuffer(b"".join(rows.column("signature").to_pylist()), np.uint8).reshape(-1, COORDS)
            starts, ends = _runs(rows.column("cell").to_numpy())
            short = ends - starts <= 8
            a, b = [], []
            i, j = _pairs(starts[short], ends[short])
            for at in range(0, len(i), 1 << 16):
                p, q = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
                near = (signs[p] == signs[q]).sum(1) >= least
                a.append(ids[p[near]])
                b.append(ids[q[near]])
            for s, e in zip(starts[~short], ends[~short], strict=True):
                own = signs[s:e]
                tree = [*_forest(e - s, lambda x, rest, own=own: (own[rest] == own[x]).sum(1) >= least)]
                if tree:
                    x, y = np.array(tree).T
                    a.append(ids[s + x])
                    b.append(ids[s + y])
            if a:
                yield _edges(np.concatenate(a), np.concatenate(b))

    return step


def _links_step(percent: int):
    def step(batches):
        for rows in _by_cell(batches, "cell"):
            ids = rows.column("id").to_numpy()
            starts, ends = _runs(rows.column("cell").to_numpy())
            sets = rows.column("shingles")
            a, b = [], []
            for s, e in zip(starts, ends, strict=True):
                parts = [np.frombuffer(x, M) for x in sets.slice(s, e - s).to_pylist()]
                sizes = np.array([len(x) for x in parts])
                values, place = np.unique(np.concatenate(parts), return_inverse=True)
                offsets = np.r_[0, np.cumsum(sizes)]
                mark = np.zeros(len(values), np.int32)

                def near(x, rest, sizes=sizes, place=place, offsets=offsets, mark=mark):
                    out = np.zeros(len(rest), bool)
                    fit = (100 * np.minimum(sizes[rest], sizes[x]) >= percent * np.maximum(sizes[rest], sizes[x]))
                    if fit.any():
                        own = place[offsets[x] : offsets[x + 1]]
                        mark[own] = 1
                        some = rest[fit]
                        if len(some) * 4 < len(sizes):
                            both = np.array([mark[place[offsets[y] : offsets[y + 1]]].sum() for y in some])
                        else:
                            both = np.add.reduceat(mark[place], offsets[:-1])[some]
                        mark[own] = 0
                        out[fit] = 100 * both >= percent * (sizes[some] + sizes[x] - both)
                    return out

                if tree := [*_forest(e - s, near)]:
                    x, y = np.array(tree).T
                    a.append(ids[s + x])
                    b.append(ids[s + y])
            if a:
                yield _edges(np.concatenate(a), np.concatenate(b))

    return step


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): components over 100 * intersection >= percent * union of k-word shingles."""
    bounded_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = durable(slim.mapInArrow(_signed_step(k), "doc_id long, n_shingles long, set_key binary, signature binary"), "signed")
    member = rows.select("doc_id", "n_shingles", "set_key")
    # one row for each distinct set
    reps = durable(
        rows.where("doc_id is not null and set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("id"), F.any_value("signature").alias("signature")), "sets"
    )
    loose = int(np.ceil(COORDS * (LOOSE * percent / 80 + (1 - LOOSE * percent / 80) / 256)))

    def keys(batches):
        """Bands' keys in blocks: the band's number and its bytes in one long."""
        for batch in batches:
            signs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, BANDS, ROWS).astype(np.int64)
            key = np.arange(BANDS, dtype=np.int64) << 48
            for r in range(ROWS):
                key = key | (signs[:, :, r] << (8 * r))
            flat = pa.array(key.ravel())
            offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * BANDS)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, flat)], ["id", "bands"])

    bands = reps.select("id", "signature").mapInArrow(keys, "id long, bands array<long>").select("id", F.explode("bands").alias("band"))
    cells = dealt(bands.withColumn("w", F.lit(1)), "band", "w").select("id", "cell").join(reps.select("id", "signature"), "id").select("cell", "id", "signature")
    alike = cells.repartition("cell").sortWithinPartitions("cell", "id").mapInArrow(_alike_step(loose), "a long, b long")
    groups = connected_components(alike)

    # only the texts in candidate groups are shingled again, for their full sets
    wanted = groups.join(reps.select("id", "set_key"), "id").select(F.col("id").alias("doc_id"), "set_key", F.col("component").alias("group"))
    sets = slim.join(wanted, "doc_id").select("doc_id", "text", "set_key", "group").mapInArrow(_sets_step(k), "id long, group long, n_shingles long, shingles binary")
    sets = durable(sets, "shingles")
    whole = dealt(sets.drop("shingles"), "group", "n_shingles").select("id", "cell").join(sets.select("id", "shingles"), "id").select("cell", "id", "shingles")
    links = whole.repartition("cell").sortWithinPartitions("cell", "id").mapInArrow(_links_step(percent), "a long, b long")
    found = connected_components(links)

    final = reps.select("set_key", "id").join(found.select("id", F.col("component").alias("linked")), "id", "left").select("set_key", F.least("id", "linked").alias("component_id"))
    out = member.join(final, "set_key", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
    out = durable(out.withColumn("kept", F.col("doc_id") == F.col("component_id")), "near")
    for used in (rows, reps, sets, groups, found):
        drop_durable(used)
    return out


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id") -> DataFrame:
    """`docs` with one document of each component; rows that repeat an id stay or go together.

    The ids that go grow with the table, so the join is by sorted partitions at every size.
    """
    dropped = near_duplicates(docs, k, percent, id_col).where("not kept").select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(dropped.hint("merge"), id_col, "left_anti").select(*docs.columns)
