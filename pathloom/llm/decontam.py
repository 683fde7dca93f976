"""Benchmark decontamination: BM25 with block-max WAND over the test items, then overlap of question and answer."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, forget, raw, written

_CLEAN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
K1, B = 1.2, 0.75
SHARD_BYTES = 8 << 20
SHINGLE = 5
BLOCK = 8  # items that share a bound
_END = re.compile(rb"[.?!:]\s+|\n")


def words(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) runs of ASCII letters, digits and non-ASCII bytes."""
    return text.translate(_CLEAN).split()


def question_answer(text: bytes) -> tuple[list[bytes], list[bytes]]:
    """The last sentence or line is the answer; without one, the last third of the words."""
    cuts = [m.end() for m in _END.finditer(text) if words(text[: m.end()]) and words(text[m.end() :])]
    if cuts:
        return words(text[: cuts[-1]]), words(text[cuts[-1] :])
    all_words = words(text)
    k = len(all_words) - len(all_words) // 3
    return all_words[:k], all_words[k:]


def shingles(tokens: list[bytes]) -> set[tuple[bytes, ...]]:
    return {tuple(tokens[i : i + SHINGLE]) for i in range(max(1, len(tokens) - SHINGLE + 1))} if tokens else set()


@dataclass
class Index:
    """Inverted index of one shard of items. Impacts are BM25 weights as shares of the item's score against itself."""

    item_ids: list[int | None]
    tokens: list[list[bytes]]
    question: list[list[bytes]]
    answer: list[list[bytes]]
    vocabulary: dict[bytes, int]
    start: np.ndarray  # of each term's postings
    items: np.ndarray
    impacts: np.ndarray
    most: np.ndarray  # each term's largest impact
    range_start: np.ndarray  # of each term's ranges of `block` items
    ranges: np.ndarray
    range_most: np.ndarray  # the term's largest impact in each of them
    rest: float  # what the terms without postings in `open` can add to any item, at most
    open: np.ndarray  # whether a term counts before WAND
    longest: int
    block: int = BLOCK


@dataclass
class Whole:
    """What BM25 counts over all items of a benchmark, whatever shard they are in."""

    n: int
    mean: float
    longest: int
    df: dict[bytes, int]  # of the shard's terms at least


def build(items: list[tuple[int | None, bytes]], share: float = 0.15, whole: Whole | None = None) -> Index:
    """Items without a word are left out: nothing can hold them. Without `whole`, the items are the whole benchmark."""
    parted = [(i, words(t), *question_answer(t)) for i, t in items]
    parted = [p for p in parted if p[1]]
    counts = [dict(zip(*np.unique(np.array(p[1], object), return_counts=True), strict=True)) for p in parted]
    vocabulary = {w: k for k, w in enumerate(sorted({w for c in counts for w in c}))}
    n, mean = len(parted), sum(len(p[1]) for p in parted) / max(1, len(parted))
    df = np.zeros(len(vocabulary))
    for c in counts:
        for w in c:
            df[vocabulary[w]] += 1
    longest = max((len(p[1]) for p in parted), default=1)
    of_all, of_any = df, n
    if whole is not None:
        of_all, of_any, mean, longest = np.array([whole.df[w] for w in vocabulary], float), whole.n, whole.mean, whole.longest
    idf = np.log(1 + (of_any - of_all + 0.5) / (of_all + 0.5))
    rows: list[tuple[int, int, float]] = []
    for k, (p, c) in enumerate(zip(parted, counts, strict=True)):
        own = [(vocabulary[w], k, idf[vocabulary[w]] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(p[1]) / mean))) for w, tf in c.items()]
        total = sum(x[2] for x in own)
        rows += [(t, k, x / total) for t, k, x in own]
    rows.sort()
    term = np.array([r[0] for r in rows], np.int64)
    start = np.searchsorted(term, np.arange(len(vocabulary) + 1))
    of, impacts = np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows])
    most = np.maximum.reduceat(impacts, start[:-1]) if len(rows) else np.zeros(0)
    first = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (of[1:] // BLOCK != of[:-1] // BLOCK)]) if len(rows) else np.zeros(0, np.int64)
    range_most = np.maximum.reduceat(impacts, first) if len(rows) else np.zeros(0)
    range_start = np.searchsorted(term[first], np.arange(len(vocabulary) + 1))
    left, closed = np.zeros(n), np.zeros(len(vocabulary), bool)
    for t in np.argsort(-df, kind="stable"):  # the commonest terms, as long as together they cannot decide
        a, b = start[t], start[t + 1]
        if b - a < 3 or (left[of[a:b]] + impacts[a:b]).max() > share:
            break
        left[of[a:b]] += impacts[a:b]
        closed[t] = True
    return Index([p[0] for p in parted], [p[1] for p in parted], [p[2] for p in parted], [p[3] for p in parted], vocabulary, start, of, impacts, most, range_start, of[first] // BLOCK, range_most, float(left.max(initial=0)), ~closed, longest)


def wand(index: Index, terms: np.ndarray, threshold: float, ranges: np.ndarray | None = None) -> dict[int, float]:
    """All items whose score against the distinct terms is at least the threshold, by block-max WAND.

    The bounds of ranges of items (`ranges`, or all) prune first; in a range that is left, cursors on the
    terms' postings move to the pivot, the first item that the largest impacts there could lift to the threshold.
    """
    low = threshold - 1e-9
    lists: dict[int, list[tuple[int, float]]] = {}
    wanted = None if ranges is None else set(ranges.tolist())
    for t in terms.tolist():
        for k in range(int(index.range_start[t]), int(index.range_start[t + 1])):
            r = int(index.ranges[k])
            if wanted is None or r in wanted:
                lists.setdefault(r, []).append((t, float(index.range_most[k])))
    found: dict[int, float] = {}
    for r, own in lists.items():
        if sum(most for _, most in own) < low:
            continue
        cursors = []
        for t, most in own:
            a, b = int(index.start[t]), int(index.start[t + 1])
            lo = a + int(np.searchsorted(index.items[a:b], r * index.block))
            hi = a + int(np.searchsorted(index.items[a:b], (r + 1) * index.block))
            cursors.append((index.items[lo:hi].tolist(), index.impacts[lo:hi].tolist(), most))
        place = [0] * len(cursors)
        order = list(range(len(cursors)))
        while order:
            order.sort(key=lambda k: cursors[k][0][place[k]])
            bound, pivot = 0.0, -1
            for k in order:
                bound += cursors[k][2]
                if bound >= low:
                    pivot = cursors[k][0][place[k]]
                    break
            if pivot < 0:
                break
            if cursors[order[0]][0][place[order[0]]] == pivot:
                score = 0.0
                for k in order:
                    items, impacts, _ = cursors[k]
                    if items[place[k]] != pivot:
                        break
                    score += impacts[place[k]]
                    place[k] += 1
                if score >= low:
                    found[pivot] = score
            else:
                for k in order:
                    items = cursors[k][0]
                    while place[k] < len(items) and items[place[k]] < pivot:
                        place[k] += 1
            order = [k for k in order if place[k] < len(cursors[k][0])]
    return found


def _grouped(keys: np.ndarray, values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Values of each key; keys are in order."""
    if keys.size:
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        yield from zip(keys[first].tolist(), np.split(values, first[1:]), strict=True)


def overlap(index: Index, item: int, passage: list[bytes]) -> tuple[float, float, float]:
    """Shares of the item's word shingles, of its question's, and of its answer's words, that the passage has."""
    own = shingles(passage)
    for size in {min(SHINGLE, len(x)) for x in (index.tokens[item], index.question[item])} - {SHINGLE, 0}:
        own |= {tuple(passage[i : i + size]) for i in range(len(passage) - size + 1)}
    share = lambda need, have: len(need & have) / len(need) if need else 1.0
    return share(shingles(index.tokens[item]), own), share(shingles(index.question[item]), own), share(set(index.answer[item]), set(passage))


def search(index: Index, texts: list[bytes], threshold: float) -> list[list[tuple[int, float, float, float, float]]]:
    """For each text the items that one of its passages holds: (item, score, overlap, question's, answer's).

    Passages are windows of two blocks of as many words as the longest item has, so that any run of that
    length is whole in one. Upper bounds on a window's score decide which passages WAND sees; no passage
    that could reach the threshold is missed.
    """
    get = index.vocabulary.get
    tokens = [words(t) for t in texts]
    span = index.longest
    ids = np.array([get(w, -1) for ws in tokens for w in ws], np.int64)
    sizes = np.array([len(w) for w in tokens], np.int64)
    first = np.cumsum(sizes) - sizes
    blocks = -(-sizes // span)
    block_first = np.cumsum(blocks) - blocks
    n = int(blocks.sum())
    out: list[list[tuple[int, float, float, float, float]]] = [[] for _ in texts]
    if not n or not index.item_ids:
        return out
    doc = np.repeat(np.arange(len(texts)), sizes)
    block = block_first[doc] + (np.arange(ids.size) - first[doc]) // span
    hit = ids >= 0
    hit[hit] = index.open[ids[hit]]
    size = len(index.vocabulary)
    owner = np.repeat(np.arange(len(texts)), blocks)
    pairs = np.r_[owner[1:] == owner[:-1], False]
    least = threshold - index.rest - 1e-9
    # the largest impacts of the distinct terms of a window's two blocks: a passage below is not worth a query
    met = np.unique(block[hit] * size + ids[hit])
    of, term = met // size, met % size
    bound = np.bincount(of, index.most[term], n)
    hot = bound + np.where(pairs, np.r_[bound[1:], 0.0], 0.0) >= least
    # block maxima: for each range of items, the largest impacts there of the distinct terms of the whole passage
    here, before = hot[of], np.r_[False, hot[:-1] & pairs[:-1]][of]
    met = np.unique(np.concatenate([met[here], met[before] - size]))
    of, term = met // size, met % size
    runs = index.range_start[term + 1] - index.range_start[term]
    at = np.repeat(index.range_start[term] - (np.cumsum(runs) - runs), runs) + np.arange(runs.sum())
    width = -(-len(index.item_ids) // index.block)
    cells, where = np.unique(np.repeat(of, runs) * width + index.ranges[at], return_inverse=True)
    open_cells = cells[np.bincount(where, index.range_most[at], cells.size) >= least]
    for b, ranges in _grouped(open_cells // width, open_cells % width):
        d = int(owner[b])
        a = (b - int(block_first[d])) * span
        passage = tokens[d][a : a + 2 * span]
        terms = ids[first[d] + a : first[d] + min(a + 2 * span, int(sizes[d]))]
        for item, score in wand(index, np.unique(terms[terms >= 0]), threshold, ranges).items():
            out[d].append((item, score, *overlap(index, item, passage)))
    return out


def matches(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.6, least: float = 0.8, least_question: float = 0.5, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, item_id, score, overlap, question_overlap, answer_overlap): the test items that whole texts hold.

    A passage is retrieved if it has `threshold` of the item's own BM25 score, and counts if it has `least`
    of the item's five-word shingles and of its answer's words, and `least_question` of its question's
    shingles (shorter texts: their whole sequence). One row for each document and item, with its best passage.
    Null and empty texts and items match nothing; documents without a match have no row; rows repeat with
    repeated doc_ids, and each item of a repeated or null item_id counts for itself. An empty table on
    either side gives an empty result; other columns are ignored. The index is sent to executors in shards of items of at most `shard_bytes` of text
    each (one item at least), one pass over the documents for each shard.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, score double, overlap double, question_overlap double, answer_overlap double"
    out = None
    for index in _shards(benchmark, shard_bytes):

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in chunks(batch, "text"):
                    rows = []
                    for doc_id, found in zip(part.column("doc_id").to_pylist(), search(index, raw(part, "text"), threshold), strict=True):
                        best: dict[int, tuple] = {}
                        for item, *values in found:
                            if _counts(values, least, least_question):
                                best[item] = max(best.get(item, (0.0,)), tuple(values))
                        rows += [(doc_id, index.item_ids[i], *v) for i, v in sorted(best.items())]
                    if rows:
                        yield pa.RecordBatch.from_pydict(dict(zip(["doc_id", "item_id", "score", "overlap", "question_overlap", "answer_overlap"], zip(*rows, strict=True), strict=True)))

        part = texts.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.6, least: float = 0.8, least_question: float = 0.5, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """docs without the rows that hold a test item, by the rules of matches(); all columns, null and empty texts stay."""
    schema = T.StructType(docs.schema.fields)
    for index in _shards(benchmark, shard_bytes):

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in chunks(batch, "text"):
                    held = [any(_counts(v, least, least_question) for _, *v in found) for found in search(index, raw(part, "text"), threshold)]
                    yield part.filter(pa.array([not x for x in held], pa.bool_()))

        docs = docs.mapInArrow(run, schema)
    return docs


def _counts(values: list[float], least: float, least_question: float) -> bool:
    _, whole, question, answer = values
    return whole >= least and question >= least_question and answer >= least


def _shards(benchmark: DataFrame, shard_bytes: int) -> Iterator[Index]:
    """Indexes of hash shards of the items, collected one at a time, of about `shard_bytes` of text each.

    Document frequencies, mean length and longest item are of the whole benchmark in each of them.
    """
    total = benchmark.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    shards = int(-(-total // shard_bytes)) or 1
    items = benchmark.where(F.col("text").isNotNull()).withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)))
    sizes = df = None
    if shards > 1:
        sizes = items.select("text").mapInArrow(_lengths, "n long, words long, longest long").agg(F.sum("n").alias("n"), F.sum("words").alias("words"), F.max("longest").alias("longest")).first()
        df = written(items.select("text").mapInArrow(_terms, "word binary").groupBy("word").agg(F.count("*").alias("n")), "terms")
    for shard in range(shards):
        own = items.where(F.col("shard") == shard)
        whole = None
        if df is not None:
            found = df.join(own.select("text").mapInArrow(_terms, "word binary").distinct(), "word", "left_semi").toArrow()
            whole = Whole(sizes["n"] or 0, (sizes["words"] or 0) / max(1, sizes["n"] or 0), sizes["longest"] or 1, dict(zip(found.column("word").to_pylist(), found.column("n").to_pylist(), strict=True)))
        found = [(r["item_id"], r["text"].encode()) for r in own.select("item_id", "text").collect()]
        yield build(sorted(found, key=lambda x: (x[0] is None, x[0] or 0, x[1])), whole=whole)
    if df is not None:
        forget(df)


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(n, words, longest) of the items with a word."""
    for batch in batches:
        sizes = [k for k in (len(words(t)) for t in raw(batch, "text")) if k]
        if sizes:
            yield pa.RecordBatch.from_pydict({"n": [len(sizes)], "words": [sum(sizes)], "longest": [max(sizes)]})


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct words of each item."""
    for batch in batches:
        for part in chunks(batch, "text"):
            yield pa.RecordBatch.from_arrays([pa.array([w for t in raw(part, "text") for w in set(words(t))], pa.binary())], ["word"])
