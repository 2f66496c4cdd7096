"""Test items that appear, fully or partly, in a corpus.

Every test item is cut into passages of ``window`` words (the whole item where it
is shorter). A passage that occurs in a document with at most ``max_edits`` word
edits must share at least one of its ``max_edits + 1`` pieces exactly. So piece
hits are found first, and around each hit the passage is verified with bit-parallel
edit distance over words. The corpus is read once, whatever the number of items.

Items of up to ``block_words`` words in all (their size is measured) are given to
every worker, which searches all pieces with one automaton; nothing is shuffled.
More items than that stay a DataFrame: their pieces are keyed by a hash, a bit map
of fixed size over these hashes sifts the word sequences of each document, and what
passes is joined with the pieces by hash, carrying the words around it. A piece
that occurs in very many places is split over several tasks.

Defined cases: NULL or empty texts have no words and match nothing; an item of
fewer than ``window`` words must match as a whole; an item with no more words
than edits allows one edit less than it has words; repeated documents are each
reported; items with equal text are each reported; whole texts are searched,
whatever their length; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .words import words

_SCHEMA = "doc_id long, item_id long, distance int, doc_word int, item_word int, n_words int"
_ARROW = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int32()), ("doc_word", pa.int32()), ("item_word", pa.int32()), ("n_words", pa.int32())])


def best_match(pattern: list[str], text: list[str]) -> tuple[int, int]:
    """(least word edits, end) of the pattern over all stretches of the text.

    Myers' bit-parallel recurrence with one bit per pattern word; the text may
    start and end anywhere. end: words of the text up to the match's end.
    """
    m = len(pattern)
    if not m:
        return 0, 0
    at: dict[str, int] = {}
    for i, w in enumerate(pattern):
        at[w] = at.get(w, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best, end = m, 0
    for j, w in enumerate(text, 1):
        eq = at.get(w, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph = down | ~(xh | up) & full
        mh = up & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph <<= 1
        mh <<= 1
        up = (mh | ~(xv | ph)) & full
        down = ph & xv & full
        if score < best:
            best, end = score, j
    return best, end


def pieces_of(n: int, window: int, max_edits: int) -> Iterator[tuple[int, int, int]]:
    """(start of the passage, place of the piece in it, its length) for an item of n words."""
    size = min(window, n)
    if not size:
        return
    pieces = min(max_edits, size - 1) + 1
    length = size // pieces
    for start in range(n - size + 1):
        for p in range(pieces):
            yield start, p * length, length


class Index:
    """Pieces of a block of items in an automaton."""

    def __init__(self, items: list[tuple[int, list[str]]], window: int, max_edits: int):
        import ahocorasick

        self.items = [w for _, w in items]
        self.ids = [i for i, _ in items]
        self.window, self.max_edits = window, max_edits
        self.automaton = ahocorasick.Automaton()
        spots: dict[str, list[tuple[int, int, int]]] = {}
        for k, w in enumerate(self.items):
            for start, offset, length in pieces_of(len(w), window, max_edits):
                spots.setdefault(" ".join(w[start + offset : start + offset + length]), []).append((k, start, offset))
        for piece, found in spots.items():
            self.automaton.add_word(f" {piece} ", (len(piece), found))
        if spots:
            self.automaton.make_automaton()
        self.empty = not spots

    def search(self, doc: list[str]) -> list[tuple[int, int, int, int, int]]:
        """(item id, distance, document word, item word, window) of the best passage per item."""
        if self.empty or not doc:
            return []
        line = f" {' '.join(doc)} "
        best: dict[int, tuple[int, int, int, int]] = {}
        tried: set[tuple[int, int, int]] = set()
        upto, n_before = 0, 0  # words before a position of the line, counted as hits advance
        for end, (length, spots) in self.automaton.iter(line):
            begin = end - length - 1
            if begin >= upto:
                n_before += line.count(" ", upto, begin)
                at = n_before
                upto = begin
            else:
                at = n_before - line.count(" ", begin, upto)
            for k, start, offset in spots:
                known = best.get(k)
                if known and known[0] == 0 or (k, start, at - offset) in tried:
                    continue
                tried.add((k, start, at - offset))
                passage = self.items[k][start : start + self.window]
                edits = min(self.max_edits, len(passage) - 1)
                low = max(0, at - offset - edits)
                distance, _ = best_match(passage, doc[low : at - offset + len(passage) + edits])
                if distance <= edits and (known is None or distance < known[0]):
                    best[k] = (distance, max(0, at - offset), start, len(passage))
        return [(self.ids[k], *v) for k, v in best.items()]


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _by_automaton(docs: DataFrame, items: list[tuple[int, str]], window: int, max_edits: int) -> DataFrame:
    given = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index([(i, words(t)) for i, t in given.value], window, max_edits)
        for b in batches:
            rows = []
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if t:
                    rows += [(d, *r) for r in index.search(words(t))]
            if rows:
                yield _batch(rows, _ARROW)

    return docs.mapInArrow(run, _SCHEMA)


# ---------------------------------------------------------- many items: hashes

_BASE = np.uint64(0x9E3779B97F4A7C15)
_CHUNK_BITS = 15
_PIECES = pa.schema([("h", pa.int64()), ("length", pa.int32()), ("item_id", pa.int64()), ("start", pa.int32()), ("offset", pa.int32()), ("passage", pa.string())])
_HITS = pa.schema([("h", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int32()), ("begin", pa.int32()), ("around", pa.string())])


def sequence_hashes(doc: list[str], length: int) -> np.ndarray:
    """A 64-bit hash of every ``length`` consecutive words."""
    import xxhash

    known = {w: xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in set(doc)}
    one = np.fromiter((known[w] for w in doc), np.uint64, len(doc))
    m = len(doc) - length + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(m, length, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(length):
            out = out * _BASE + one[j : j + m]
    return out ^ (out >> np.uint64(29))


def _pieces(items: DataFrame, window: int, max_edits: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                w = words(t)
                hashes: dict[int, np.ndarray] = {}
                for start, offset, length in pieces_of(len(w), window, max_edits):
                    if length not in hashes:
                        hashes[length] = sequence_hashes(w, length).view(np.int64)
                    rows.append((int(hashes[length][start + offset]), length, i, start, offset, " ".join(w[start : start + window])))
            if rows:
                yield _batch(rows, _PIECES)

    return items.mapInArrow(run, "h long, length int, item_id long, start int, offset int, passage string")


def _bit_map(pieces: DataFrame, bits: int) -> np.ndarray:
    """2 ** bits bits, set where a hash of the pieces points; put together in chunks on the executors."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << bits >> 3, np.uint8)
        for b in batches:
            place = b.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - bits)
            np.bitwise_or.at(seen, place >> np.uint64(3), np.uint8(1) << (place & np.uint64(7)).astype(np.uint8))
        chunks = seen.reshape(-1, 1 << max(min(_CHUNK_BITS, bits) - 3, 0))
        used = np.flatnonzero(chunks.any(axis=1))
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([chunks[k].tobytes() for k in used], pa.binary())], ["chunk", "map"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole: dict[int, np.ndarray] = {}
        for b in batches:
            for k, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                part = np.frombuffer(m, np.uint8)
                whole[k] = whole[k] | part if k in whole else part
        if whole:
            yield pa.RecordBatch.from_arrays([pa.array(list(whole), pa.int32()), pa.array([m.tobytes() for m in whole.values()], pa.binary())], ["chunk", "map"])

    schema = "chunk int, map binary"
    rows = pieces.select("h").mapInArrow(partial, schema).repartition("chunk").mapInArrow(join, schema).collect()  # 2 ** bits bits at most
    out = np.zeros(1 << bits >> 3, np.uint8).reshape(-1, 1 << max(min(_CHUNK_BITS, bits) - 3, 0))
    for r in rows:
        out[r.chunk] = np.frombuffer(r.map, np.uint8)
    return out.ravel()


def _hits(docs: DataFrame, sieve: np.ndarray, lengths: list[int], bits: int, reach: int) -> DataFrame:
    given = docs.sparkSession.sparkContext.broadcast(sieve)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = given.value
        for b in batches:
            rows = []
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                doc = words(t)
                for length in lengths:
                    h = sequence_hashes(doc, length)
                    place = h >> np.uint64(64 - bits)
                    at = np.flatnonzero(seen[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1)
                    signed = h.view(np.int64)
                    rows += [(int(signed[k]), d, int(k), max(0, int(k) - reach), " ".join(doc[max(0, int(k) - reach) : int(k) + reach])) for k in at]
            if rows:
                yield _batch(rows, _HITS)

    return docs.mapInArrow(run, "h long, doc_id long, at int, begin int, around string")


def _verified(pairs: DataFrame, max_edits: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for d, i, at, begin, around, start, offset, passage in zip(*(c.to_pylist() for c in b.columns)):
                p, doc, first = passage.split(" "), around.split(" "), at - offset
                edits = min(max_edits, len(p) - 1)
                low = max(0, first - edits - begin)
                distance, _ = best_match(p, doc[low : max(0, first + len(p) + edits - begin)])
                if distance <= edits:
                    rows.append((d, i, distance, max(0, first), start, len(p)))
            if rows:
                yield _batch(rows, _ARROW)

    return pairs.select("doc_id", "item_id", "at", "begin", "around", "start", "offset", "passage").mapInArrow(run, _SCHEMA)


def _by_hashes(docs: DataFrame, items: DataFrame, window: int, max_edits: int, bits: int, salts: int = 32) -> DataFrame:
    pieces = _pieces(items, window, max_edits)
    lengths = sorted(r.length for r in pieces.select("length").distinct().collect())  # window at most
    hits = cut(_hits(docs, _bit_map(pieces, bits), lengths, bits, window + max_edits))
    total = hits.count()
    # a hash with over a thousandth of all hits: a thousand at most
    hot = hits.groupBy("h").count().filter(F.col("count") > F.lit(max(total // 1000, 10_000))).select("h", F.lit(salts).alias("_n"))
    spread = hits.join(F.broadcast(hot), "h", "left").withColumn("_salt", F.pmod(F.xxhash64("doc_id", "at"), F.coalesce("_n", F.lit(1))).cast("int")).drop("_n")
    copies = pieces.join(F.broadcast(hot), "h", "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_n", F.lit(1)) - 1))).drop("_n", "length")
    best = F.min(F.struct("distance", "doc_word", "item_word", "n_words")).alias("b")
    return _verified(spread.join(copies, ["h", "_salt"]), max_edits).groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.*")


def find_leaks(
    documents: DataFrame, items: DataFrame, window: int = 12, max_edits: int = 1, doc_id: str = "doc_id",
    item_id: str = "item_id", text: str = "text", block_words: int = 100_000, bits: int = 27,
) -> DataFrame:
    """doc_id, item_id, distance, doc_word, item_word, n_words; one row per pair.

    The row holds one of the best passages: its edits, where it begins in document
    and item, and its length in words. distance 0 means that ``window`` consecutive
    words (or the whole shorter item) are shared. block_words: words of items that
    a worker may hold, whose automaton takes some hundred MB; bits: size of the bit
    map (as a power of two) used beyond that.
    """
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    tests = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text")).filter("text is not null and item_id is not null").distinct()
    chars = tests.agg(F.sum(F.length("text") + 1)).first()[0] or 0
    if chars <= 6 * block_words:
        return _by_automaton(docs, [(r.item_id, r.text) for r in tests.collect()], window, max_edits)
    return _by_hashes(docs, tests, window, max_edits, bits)


def leaked_items(leaks: DataFrame) -> DataFrame:
    """Per item the documents that hold a passage of it and the best distance."""
    return leaks.groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_documents"), F.min("distance").alias("distance"))
