"""Packing of tokenized documents into fixed windows by non-negative least squares over the length histogram.

1. Every text is tokenized whole and its ids are cut at multiples of the window; all but the last piece are full.
2. Piece lengths are binned in steps of `step` tokens. The histogram (window / step bins, whatever the data's size) is
   all that the planning sees.
3. Shallow combinations of up to three bins that fill a window exactly are enumerated; non-negative least squares gives
   how often to use each for the histogram; counts are rounded down and cut back where they'd use more than there is.
4. What the histogram then still has is packed greedily, largest piece first, each window with the largest that fits.
5. A piece's rank in its bin finds its sequence in the plan. Ranks come from one range-partitioned numbering by (bin,
   doc_id, start), so that a bin with most of the pieces is spread over tasks like any other.

Nulls: a null text is an empty one, which has the end-of-document id alone; rows without doc_id are packed like others.
Repeated rows are separate documents. An empty table gives no pieces. Other columns are ignored, whatever their names.
The longest text must fit a task's memory together with its ids.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import bounded_batches, drop_durable, durable, renamed
from .sharding import numbered
from .wordhash import LOWER, SPACED, Words, chunks

WINDOW, STEP, DEPTH, END_ID = 2048, 8, 3, 1
M = np.uint64


# --- tokens ----------------------------------------------------------------------------------------------------------


class WordTokenizer:
    """Ids of whole texts, through a cache by white-space-separated word.

    For tokenizers with word ends that compose, lower-case and cut texts into words and runs of punctuation: there a text's ids
    are its words' ids in a row, and a mark after a letter stands for itself. Words are looked up by
    their 64-bit hashes in a table of numpy arrays, a batch at a time; it points into one array of ids. Only words not seen yet
    come to the tokenizer itself, many in one text. Words past U+02FF, and any with "<|", which may begin a special token,
    are kept by their exact bytes instead. Table and ids are emptied when full.
    """

    BITS, PROBES, MOST_IDS = 21, 8, 8_000_000

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._clear()

    def _clear(self) -> None:
        n = (1 << self.BITS) + self.PROBES
        self.keys, self.start, self.size = np.zeros(n, np.uint64), np.zeros(n, np.int32), np.zeros(n, np.int32)
        self.exact: dict[bytes, tuple[int, int]] = {}
        self.pool, self.used, self.words = np.zeros(1 << 16, np.uint32), 0, 0

    def _store(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Put the ids of some words into the pool; where each word's begin."""
        end = self.used + len(ids)
        while end > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : end] = ids
        start, self.used = self.used + np.cumsum(sizes) - sizes, end
        return start

    # encoding: (ids of all words, number of each one's)

    def _encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in words], add_special_tokens=False) if words else []
        ids = [e.ids for e in found]
        return np.array([i for own in ids for i in own], np.uint32), np.array([len(own) for own in ids], np.int64)

    def _encode_letters(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All in one text: a word of letters alone has one id that ends a word, its last."""
        if not words:
            return self._encode(words)
        ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(words).decode()], add_special_tokens=False)[0].ids, np.uint32)
        cuts = np.flatnonzero(self.ends[ids]) + 1
        return (ids, np.diff(cuts, prepend=0)) if len(cuts) == len(words) else self._encode(words)

    def _encode_plain(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(first id in the pool, number of ids) of lower-case words up to U+02FF, where nothing composes anew in lower case."""
        simple, rest = [], []
        for i, w in enumerate(words):
            (simple if w.decode().isalpha() else rest).append(i)
        start, size = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        for at, encode in ((simple, self._encode_letters), (rest, self._encode)):
            ids, sizes = encode([words[i] for i in at])
            start[at], size[at] = self._store(ids, sizes), sizes
        return start, size

    # lookup

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """The table's place of each hash, -1 for those not in it."""
        home = (hashes >> M(64 - self.BITS)).astype(np.int64)
        place = np.where(self.keys[home] == hashes, home, -1)
        left = np.flatnonzero(place < 0)
        for probe in range(1, self.PROBES):
            if not len(left):
                break
            at = home[left] + probe
            hit = self.keys[at] == hashes[left]
            place[left[hit]] = at[hit]
            left = left[~hit]
        return place

    def _insert(self, hashes: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        """Into the first free place of each; where there's none, over another word."""
        home = (hashes >> M(64 - self.BITS)).astype(np.int64)
        left = np.arange(len(hashes))
        for probe in range(self.PROBES + 1):
            at = home[left] + (probe if probe < self.PROBES else (hashes[left] % M(self.PROBES)).astype(np.int64))
            at, one = np.unique(at, return_index=True)
            if probe < self.PROBES:
                free = self.keys[at] == 0
                at, one = at[free], one[free]
            self.keys[at], self.start[at], self.size[at] = hashes[left[one]], start[left[one]], size[left[one]]
            left = np.delete(left, one)

    @staticmethod
    def _cut_marks(words: Words) -> None:
        """A full stop or comma after an ASCII letter becomes a word of its own, so that far fewer words are distinct."""
        last = words.end - 1
        cut = (words.end - words.start > 1) & _MARK[words.data[last]] & _LETTER[words.data[last - 1]]
        words.first = words.first + np.concatenate([[0], np.cumsum(cut)])[words.first]
        words.start = np.sort(np.concatenate([words.start, last[cut]]))
        words.end = np.sort(np.concatenate([words.end, last[cut]]))

    def batch(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's begin and the last one's end)."""
        if self.used > self.MOST_IDS:
            self._clear()
        self._cut_marks(words)
        hashes, data = words.hashes(), words.data
        odd_bytes = np.flatnonzero(~_PLAIN[data])
        special = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124))
        odd = np.zeros(len(hashes), bool)
        if len(odd_bytes) + len(special):
            odd[np.searchsorted(words.start, np.concatenate([odd_bytes, special]), "right") - 1] = True
        place = self._find(hashes)
        place[odd] = 0
        start, size = self.start[place].astype(np.int64), self.size[place].astype(np.int64)
        missing = np.flatnonzero(place < 0)
        if len(missing):
            low = LOWER[data].tobytes()
            new, first, which = np.unique(hashes[missing], return_index=True, return_inverse=True)
            first = missing[first]
            s, n = self._encode_plain([low[i:j] for i, j in zip(words.start[first].tolist(), words.end[first].tolist(), strict=True)])
            start[missing], size[missing] = s[which], n[which]
            self._insert(new, s, n)
        if odd.any():
            raw, at = data.tobytes(), np.flatnonzero(odd)
            own = [raw[words.start[i] : words.end[i]] for i in at]
            if new := [*{w for w in own if w not in self.exact}]:
                ids, sizes = self._encode(new)
                self.exact.update(zip(new, zip(self._store(ids, sizes).tolist(), sizes.tolist(), strict=True), strict=True))
            start[at], size[at] = np.array([self.exact[w] for w in own]).T
        ends = np.cumsum(size)
        ids = self.pool[np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
        return ids, np.concatenate([[0], ends])[words.first]


_MARK, _LETTER = np.zeros(256, bool), np.zeros(256, bool)
_MARK[[44, 46]] = True
_LETTER[[*range(65, 91), *range(97, 123)]] = True
#: Bytes of the UTF-8 of U+0000 to U+02FF.
_PLAIN = np.zeros(256, bool)
_PLAIN[[*range(0xC0), *range(0xC2, 0xCC)]] = True

#: The normalizer and the cutting of texts with which a text's ids are its words' ids in a row.
BY_WORD = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
}


class TextTokenizer:
    """Ids of whole texts from any tokenizer, text by text."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)

    def batch(self, words: Words, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array([i for own in found for i in own], np.uint32), np.cumsum([0, *map(len, found)])


def by_word(spec: str) -> bool:
    """Whether `WordTokenizer` gives the ids of the tokenizer with this specification."""
    own = json.loads(spec)
    model = own["model"]
    return (
        all(own.get(k) == v for k, v in BY_WORD.items())
        and (model.get("type"), model.get("end_of_word_suffix"), model.get("dropout"), model.get("continuing_subword_prefix")) == ("BPE", "</w>", None, None)
        and all(t["content"].startswith("<|") and not (t["single_word"] or t["lstrip"] or t["rstrip"]) for t in own.get("added_tokens", []))
    )


_loaded: dict[int, WordTokenizer | TextTokenizer] = {}


def pieces(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, doc_tokens, ids): each document's ids and `end_id`, cut at multiples of the window.

    `ids` is binary, little-endian unsigned 32-bit. Tokenizers for which words can't be looked up one by one get whole texts. The tokenizer file (of fixed size) is read here and sent to the executors.
    """
    bounded_batches(docs.sparkSession)
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        kind = WordTokenizer if by_word(spec.value) else TextTokenizer
        tokenizer = _loaded.get(hash(spec.value)) or _loaded.setdefault(hash(spec.value), kind(spec.value))
        for batch in batches:
            for i, j, words in chunks(batch.column(1), SPACED):
                ids, bounds = tokenizer.batch(words) if kind is WordTokenizer else tokenizer.batch(words, [t.as_py() or "" for t in batch.column(1).slice(i, j - i)])
                with_end = np.insert(ids, bounds[1:], end_id)
                bounds = bounds + np.arange(j - i + 1)
                totals = np.diff(bounds)
                n = -(-totals // window)
                row = np.repeat(np.arange(j - i), n)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * window
                length = np.minimum(window, totals[row] - start)
                offsets = np.concatenate([[0], np.cumsum(length)])
                parts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(row), [None, pa.py_buffer(4 * offsets), pa.py_buffer(with_end.astype("<u4"))])
                columns = [batch.column(0).slice(i, j - i).take(pa.array(row)), pa.array(start), pa.array(length), pa.array(totals[row]), parts.cast(pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "doc_tokens", "ids"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(step, "doc_id long, start long, length long, doc_tokens long, ids binary")


# --- plan ------------------------------------------------------------------------------------------------------------


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 1000, tolerance: float = 1e-5) -> np.ndarray:
    """The x >= 0 with the least |a x - b|, by the active-set method of Lawson and Hanson, over normal equations.

    It ends when no gradient exceeds `tolerance` times the largest of b, as the result is rounded anyway.
    """
    x, free = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    tolerance *= max(1e-300, np.abs(b).max(initial=0))
    for _ in range(rounds):
        pull = a.T @ (b - a @ x)
        pull[free] = -np.inf
        j = int(pull.argmax())
        if pull[j] <= tolerance:
            break
        free[j] = True
        while True:
            at = np.flatnonzero(free)
            own = a[:, at]
            z = np.linalg.solve(own.T @ own + 1e-9 * np.eye(len(at)), own.T @ b)
            if (z > 0).all():
                x[:] = 0
                x[at] = z
                break
            low = z <= 0
            share = np.min(x[at][low] / np.maximum(x[at][low] - z[low], 1e-300))
            x[at] += share * (z - x[at])
            gone = at[(x[at] <= tolerance * 1e-6) & low]
            free[gone if len(gone) else at[low]] = False
            x[~free] = 0
    return x


def fillings(bins: int, depth: int) -> list[tuple[int, ...]]:
    """All ways to fill a window of that many bins exactly with up to `depth` pieces."""
    out: list[tuple[int, ...]] = []
    for d in range(1, depth + 1):
        for part in combinations_with_replacement(range(1, bins + 1), d - 1):
            last = bins - sum(part)
            if last >= (part[-1] if part else 1):
                out.append((*part, last))
    return out


def plan(histogram: dict[int, int], bins: int = WINDOW // STEP, depth: int = DEPTH) -> list[tuple[tuple[int, ...], int]]:
    """[(bins of the pieces of a window, number of such windows)]; uses up the histogram exactly."""
    rest = np.zeros(bins + 1, np.int64)
    for b, n in histogram.items():
        rest[b] = n
    out: list[tuple[tuple[int, ...], int]] = []
    usable = [w for w in fillings(bins, depth) if all(rest[b] for b in w)]
    if usable:
        a = np.zeros((bins + 1, len(usable)))
        for j, w in enumerate(usable):
            np.add.at(a[:, j], list(w), 1)
        scale = max(1, int(rest.max()))
        repeats = np.floor(nnls(a, rest / scale) * scale + 1e-6).astype(np.int64)
        for j in np.argsort(-repeats, kind="stable"):
            uses = Counter(usable[j])
            if n := min(int(repeats[j]), *(int(rest[b]) // m for b, m in uses.items())):
                out.append((usable[j], n))
                for b, m in uses.items():
                    rest[b] -= n * m
    while rest.any():
        free, window = bins, []
        left = rest.copy()
        while free:
            fit = np.flatnonzero(left[: free + 1])
            if not len(fit):
                break
            window.append(int(fit[-1]))
            left[fit[-1]] -= 1
            free -= int(fit[-1])
        uses = Counter(window)
        n = min(int(rest[b]) // m for b, m in uses.items())
        out.append((tuple(window), n))
        for b, m in uses.items():
            rest[b] -= n * m
    return out


class Places:
    """Sequence and position of the r-th piece of a bin under a plan."""

    def __init__(self, windows: list[tuple[tuple[int, ...], int]], bins: int):
        found: list[list[tuple[int, int, int, int]]] = [[] for _ in range(bins + 1)]
        used, base = [0] * (bins + 1), 0
        for window, n in windows:
            for b, m in Counter(window).items():
                found[b].append((used[b], base, m, window.index(b)))
                used[b] += n * m
            base += n
        self.by_bin = [np.array(x, np.int64).reshape(-1, 4) for x in found]
        # equal bins stand side by side in a window
        assert all(list(w) == sorted(w) or list(w) == sorted(w, reverse=True) for w, _ in windows)

    def find(self, b: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, position = np.empty(len(b), np.int64), np.empty(len(b), np.int64)
        for one in np.unique(b):
            at = np.flatnonzero(b == one)
            rows = self.by_bin[one]
            start, base, m, first = rows[np.searchsorted(rows[:, 0], rank[at], "right") - 1].T
            sequence[at] = base + (rank[at] - start) // m
            position[at] = first + (rank[at] - start) % m
        return sequence, position


def pack(cut: DataFrame, window: int = WINDOW, step: int = STEP, depth: int = DEPTH) -> DataFrame:
    """`cut` (doc_id, start, length and what else the caller wants to carry, whatever its name) with sequence_id and offset, which replace columns of these names."""
    bins = -(-window // step)
    slim, names = renamed(cut.drop("sequence_id", "offset"))
    kept = slim.columns
    doc_id, start, length = (kept[names.index(c)] for c in ("doc_id", "start", "length"))
    slim = durable(slim, "pieces")  # else the range partitioning, which draws a sample first, would tokenize twice
    rows, n = numbered(slim.withColumn("bin", F.ceil(F.col(length) / step).cast("int")), "bin", doc_id, start)
    drop_durable(slim)
    counts = {r["bin"]: r["count"] for r in rows.groupBy("bin").count().collect()}  # at most `bins` rows
    starts, total = np.zeros(bins + 1, np.int64), 0
    for b in sorted(counts):
        starts[b] = total
        total += counts[b]
    places = cut.sparkSession.sparkContext.broadcast(Places(plan(counts, bins, depth), bins))  # bounded by the bins

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = batch.column("bin").to_numpy()
            sequence, position = places.value.find(b, batch.column("row_number").to_numpy() - starts[b])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(sequence), pa.array(position)], [*kept, "sequence_id", "position"])

    schema = rows.select(*kept, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("position")).schema
    placed = rows.mapInArrow(find, schema)
    before = Window.partitionBy("sequence_id").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)  # a window's pieces, `window` at most
    offset = F.coalesce(F.sum(length).over(before), F.lit(0).cast("long"))
    return placed.withColumn("offset", offset).select(*(F.col(c).alias(name) for c, name in zip(kept, names, strict=True)), "sequence_id", "offset")


def sequences(packed: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """(sequence_id, ids, n_tokens) from packed pieces that carry `ids`: each window's ids, padded to its size."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # of one window
    joined = F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    pad = F.unhex(F.repeat(F.lit(int(pad_id).to_bytes(4, "little").hex()), F.lit(window) - F.col("n_tokens").cast("int")))
    return packed.groupBy("sequence_id").agg(joined.alias("joined"), F.sum("length").alias("n_tokens")).select("sequence_id", F.concat("joined", pad).alias("ids"), "n_tokens")
