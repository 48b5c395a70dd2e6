"""Benchmark decontamination by winnowing.

Of the hashes of all k-word grams, each window of `span - k + 1` neighbouring grams keeps its least. A run of `span` words that a
document shares with an item holds a whole window, whose least hash both sides have kept; so no shared run is missed.
Documents' fingerprints are looked up in the items' (a hash join whose build side, the items, is taken in blocks of a
bounded size), and each hit is extended to the `span`-word windows around it, which are compared word by word.
Items under `span` words are windows of their own length; for these lengths every gram is kept.

A benchmark of one block takes one pass over the documents, which stay where they are: no shuffle, no pairs, nothing gathered, so hot
passages need no care. A larger one takes a pass a block: only one block is alive at a time, each pass writes just the hits, and
these are put together by row in the end. A block holds its items' text once and some 25 bytes a word beside it.

Words are runs of letters, digits and characters from U+0080 on, A-Z lower-cased. Null texts have no words and items
without words or id match nothing. Repeated documents are judged one by one; items that repeat an id are one item, with the windows
of all. Empty tables give an empty result, or no hits. Other columns are passed through, except that the result columns of
`find_contamination` replace columns of that name; `drop_contaminated` keeps all columns as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, drop_durable, durable, renamed
from .wordhash import ALNUM, LOWER, Words, chunks, grams

M = np.uint64
SPAN, GRAM = 10, 5
BLOCK_BYTES = 16 << 20
_BITS = 20
#: Windows whose items a worker remembers.
KNOWN = 10_000


def kept(hashes: np.ndarray, words: Words, span: int, k: int) -> np.ndarray:
    """Places of the grams that winnowing keeps."""
    wide = span - k + 1
    n = len(hashes) - wide + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    low = hashes[:n].copy()
    for j in range(1, wide):
        np.minimum(low, hashes[j : j + n], out=low)
    # windows that cross into the next text keep nothing
    sizes = np.diff(words.first)
    whole = np.zeros(len(words.start) + 1, np.int32)
    full = sizes >= span
    whole[words.first[:-1][full]] += 1
    whole[words.first[1:][full] - span + 1] -= 1
    low[np.cumsum(whole)[:n] == 0] = 0
    top = np.zeros(len(hashes), M)
    for j in range(wide):
        np.maximum(top[j : j + n], low, out=top[j : j + n])
    return np.flatnonzero(top == hashes)


def _joined(pieces: list[np.ndarray], kind) -> np.ndarray:
    """One array; the pieces are let go."""
    out = np.concatenate(pieces) if pieces else np.zeros(0, kind)
    pieces.clear()
    return out


class _Windows:
    """All windows of n words: their hashes in order, and where each begins."""

    def __init__(self, n: int, hashes: np.ndarray, at: np.ndarray):
        order = np.argsort(hashes, kind="stable")
        self.n, self.hashes, self.at = n, hashes[order], at[order]


class Block:
    """Some items, (id, text) columns: their fingerprints, and their windows as hashes over one buffer of words."""

    def __init__(self, ids: pa.Array, texts: pa.Array, span: int = SPAN, k: int = GRAM):
        self.span, self.k, self.ids = span, k, ids.cast(pa.string())
        prints, data, start, size, item = [], [], [], [], []
        gather: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        base = bytes_before = 0
        for i, _, words in chunks(texts, ALNUM):
            hashes, first, each = words.hashes(), words.first, np.diff(words.first)
            g = grams(hashes, k)
            prints.append(g[kept(g, words, span, k)])
            owner = words.owner()
            left = first[1:][owner] - np.arange(len(owner))  # words from here to the text's end
            for n in np.unique(np.minimum(each[each > 0], span)):
                places = np.flatnonzero((left >= n) if n == span else (left == n) & (each[owner] == n))
                gather.setdefault(int(n), []).append((grams(hashes, int(n))[places], (places + base).astype(np.int32)))
            data.append(LOWER[words.data])
            start.append((words.start + bytes_before).astype(np.int32))
            size.append((words.end - words.start).astype(np.int32))
            item.append((owner + i).astype(np.int32))
            base += len(owner)
            bytes_before += len(words.data)
        self.data, self.start, self.size, self.item = _joined(data, np.uint8), _joined(start, np.int32), _joined(size, np.int32), _joined(item, np.int32)
        self.prints = _Lookup(_joined(prints, M))
        self.windows = {}
        for n in sorted(gather):
            hashes, at = (list(x) for x in zip(*gather.pop(n), strict=True))
            self.windows[n] = _Windows(n, _joined(hashes, M), _joined(at, np.int32))
        self.short = {n: _Lookup(w.hashes) for n, w in self.windows.items() if n < span}
        self._known: dict[tuple[int, int], tuple[bytes, tuple[str, ...]]] = {}

    def text(self, at: int, n: int) -> bytes:
        """n words from a place, with one space between."""
        return b" ".join(self.data[s : s + z].tobytes() for s, z in zip(self.start[at : at + n].tolist(), self.size[at : at + n].tolist(), strict=True))

    def hits(self, words: Words) -> Iterator[tuple[int, int, tuple[str, ...]]]:
        """(first word, last word + 1, items) of each place where a window occurs."""
        hashes = words.hashes()
        if self.prints.n:
            g = grams(hashes, self.k)
            at = kept(g, words, self.span, self.k)
            at = at[self.prints.has(g[at])]
            if len(at):
                starts = np.unique((at[:, None] - np.arange(self.span - self.k + 1)).ravel())
                yield from self._same(words, hashes, starts[starts >= 0], self.span)
        for n, lookup in self.short.items():
            yield from self._same(words, hashes, np.flatnonzero(lookup.has(grams(hashes, n))), n)

    def _same(self, words: Words, hashes: np.ndarray, starts: np.ndarray, n: int):
        windows = self.windows.get(n)
        if not len(starts) or windows is None:
            return
        ends = words.first[np.searchsorted(words.first, starts, "right")]
        starts = starts[starts + n <= ends]
        g = grams(hashes, n)[starts]
        low = np.searchsorted(windows.hashes, g)
        fits = windows.hashes[np.minimum(low, len(windows.hashes) - 1)] == g
        for s, a in zip(starts[fits].tolist(), low[fits].tolist(), strict=True):
            if ids := self._items(windows, a, words.text(s, s + n)):
                yield s, s + n, ids

    def _items(self, windows: _Windows, low: int, text: bytes) -> tuple[str, ...]:
        """The items that have the words `text` among the windows from `low` on, all of one hash."""
        known = self._known.get((windows.n, low))
        if known is None or known[0] != text:
            high = int(np.searchsorted(windows.hashes, windows.hashes[low], "right"))
            own = {int(self.item[at]) for at in windows.at[low:high].tolist() if self.text(at, windows.n) == text}
            known = text, tuple(sorted({self.ids[i].as_py() for i in own}))
            if len(self._known) >= KNOWN:
                self._known.clear()
            self._known[windows.n, low] = known
        return known[1]


class _Lookup:
    def __init__(self, hashes: np.ndarray):
        self.all = np.unique(hashes)
        self.n = len(self.all)
        self.some = np.zeros(1 << _BITS, bool)
        self.some[(self.all >> M(64 - _BITS)).astype(np.int64)] = True

    def has(self, hashes: np.ndarray) -> np.ndarray:
        found = self.some[(hashes >> M(64 - _BITS)).astype(np.int64)]
        at = np.flatnonzero(found)
        found[at] = np.isin(hashes[at], self.all)
        return found


RESULT = [
    T.StructField("n_words", T.LongType()),
    T.StructField("hit_spans", T.ArrayType(T.LongType())),
    T.StructField("hit_items", T.ArrayType(T.StringType())),
]


def _judged(block: Block, column: pa.Array) -> tuple[np.ndarray, dict[int, list[int]], dict[int, list[str]]]:
    """Words of each text; spans and items of those with hits."""
    sizes = np.zeros(len(column), np.int64)
    spans, items = {}, {}
    for i, j, words in chunks(column, ALNUM):
        sizes[i:j] = np.diff(words.first)
        marks: dict[int, list] = {}
        for s, e, ids in block.hits(words):
            d = int(np.searchsorted(words.first, s, "right")) - 1
            marks.setdefault(d, []).append((s - int(words.first[d]), e - int(words.first[d]), ids))
        for d, found in marks.items():
            spans[i + d] = _merged([(s, e) for s, e, _ in found])
            items[i + d] = sorted({x for _, _, ids in found for x in ids})
    return sizes, spans, items


def _merged(spans: list[tuple[int, int]]) -> list[int]:
    out: list[int] = []
    for s, e in sorted(spans):
        if out and s <= out[-1]:
            out[-1] = max(out[-1], e)
        else:
            out += [s, e]
    return out


def blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES, span: int = SPAN, k: int = GRAM, id_col: str = "item_id", text_col: str = "text") -> tuple[int, Iterator[Block]]:
    """How many blocks of about `block_bytes` the benchmark has, and each, made when it is asked for."""
    slim = benchmark.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    size = slim.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    n = -(-size // block_bytes)

    def each() -> Iterator[Block]:
        for b in range(n):
            part = slim.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == b).sort("id", "text").toArrow().combine_chunks()
            yield Block(*(x.chunk(0) if x.num_chunks else pa.array([], pa.string()) for x in (part.column(0), part.column(1))), span, k)

    return n, each()


def find_contamination(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, k: int = GRAM, text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """`docs` with n_words, hit_spans (start, end, start, end ... in words, merged) and hit_items (ids as sorted strings)."""
    bounded_batches(docs.sparkSession)
    slim, names = renamed(docs.drop(*(f.name for f in RESULT)))
    text = slim.columns[names.index(text_col)]
    n, each = blocks(benchmark, block_bytes, span, k)
    if n <= 1:
        block = next(each, None) or Block(pa.array([], pa.string()), pa.array([], pa.string()), span, k)
        found = slim.mapInArrow(_step(docs.sparkSession.sparkContext.broadcast(block), text), T.StructType([*slim.schema.fields, *RESULT]))
    else:
        found = _in_passes(slim, text, each)
    return found.select(*(F.col(c).alias(name) for c, name in zip(slim.columns, names, strict=True)), *(f.name for f in RESULT))


def _result(sizes: np.ndarray, spans: dict[int, list[int]], items: dict[int, list[str]]) -> list[pa.Array]:
    rows = range(len(sizes))
    return [pa.array(sizes), pa.array([spans.get(i, []) for i in rows], pa.list_(pa.int64())), pa.array([items.get(i, []) for i in rows], pa.list_(pa.string()))]


def _step(shared, text_col: str):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for field, column in zip(RESULT, _result(*_judged(shared.value, batch.column(text_col))), strict=True):
                batch = batch.append_column(field.name, column)
            yield batch

    return step


def _in_passes(docs: DataFrame, text_col: str, each: Iterator[Block]) -> DataFrame:
    """As `_step`, a block at a time; `docs` has columns c0, c1 ..."""
    spark = docs.sparkSession
    kept = durable(docs.withColumn("row", F.monotonically_increasing_id()), "decontaminate")
    hits = []
    for block in each:
        shared = spark.sparkContext.broadcast(block)
        del block  # on storage now; the next isn't made before this one's pass is over
        hits.append(durable(kept.select("row", text_col).mapInArrow(_only_hits(shared, text_col), "row long, spans array<bigint>, items array<string>"), "hits"))
        shared.destroy()
    once = hits[0]
    for more in hits[1:]:
        once = once.unionByName(more)
    own = docs.columns
    # at most one entry a block for each row
    by_row = durable(once.groupBy("row").agg(F.collect_list("spans").alias("spans"), F.collect_list("items").alias("items")), "hits")
    for part in hits:
        drop_durable(part)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.zeros(batch.num_rows, np.int64)
            for i, j, words in chunks(batch.column(text_col), ALNUM):
                sizes[i:j] = np.diff(words.first)
            spans, items = {}, {}
            for i, found in enumerate(batch.column("spans").to_pylist()):
                spans[i] = _merged([pair for x in found or [] for pair in zip(x[::2], x[1::2], strict=True)])
            for i, found in enumerate(batch.column("items").to_pylist()):
                items[i] = sorted({x for ids in found or [] for x in ids})
            out = batch.select(own)
            for field, column in zip(RESULT, _result(sizes, spans, items), strict=True):
                out = out.append_column(field.name, column)
            yield out

    return kept.join(by_row, "row", "left").mapInArrow(step, T.StructType([*docs.schema.fields, *RESULT]))


def _only_hits(shared, text_col: str):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, spans, items = _judged(shared.value, batch.column(text_col))
            at = sorted(spans)
            yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(at, pa.int64())), pa.array([spans[i] for i in at], pa.list_(pa.int64())), pa.array([items[i] for i in at], pa.list_(pa.string()))], ["row", "spans", "items"])

    return step


def digest(found: DataFrame) -> DataFrame:
    """Counts and a checksum in place of spans and ids."""
    n_hit = F.aggregate("hit_spans", F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-1).cast("long").alias("sign")), lambda a, x: F.struct((a["sum"] + a["sign"] * x).alias("sum"), (-a["sign"]).alias("sign")), lambda a: a["sum"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        (F.size("hit_spans") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a hit, with their columns as they are."""
    slim, names = renamed(docs)
    found = find_contamination(slim, benchmark, text_col=slim.columns[names.index("text")])
    return found.where(F.size("hit_spans") == 0).select(*slim.columns).toDF(*names)
