"""Language identification: one interpolated Kneser-Ney character model for each language."""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, fold

BITS = 6
CLASSES = 1 << BITS  # 0: no letter; 1-26: a-z; the others share the remaining classes by code point
ORDER = 4  # so a model has at most 2**24 n-grams
FEW = 30  # texts; a language with fewer has no deviation to trust
_PLACES: dict[str, np.ndarray] = {}


@lru_cache(1)
def _classes() -> np.ndarray:
    """The class of each code point's lower case."""
    out = np.zeros(0x110000, np.uint8)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            low = ord(c.lower()[0])
            out[cp] = low - 96 if 97 <= low <= 122 else 27 + low % (CLASSES - 27)
    return out


def classes_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all texts in a row, each text between non-letters and runs of these as one; and where texts begin."""
    joined = "\n" + "\n".join(texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    x = _classes()[points].astype(np.int32)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    starts = np.r_[0, ends[:-1]]
    keep = np.r_[True, (x[1:] != 0) | (x[:-1] != 0)]
    keep[starts] = True  # so that every text has its own beginning
    place = np.cumsum(keep) - 1
    return x[keep], place[starts]


def grams(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Code of the n-gram that ends at each place; what lies before a text's beginning counts as non-letters."""
    place = np.arange(x.size) - np.repeat(starts, np.diff(np.r_[starts, x.size]))
    out = x.copy()
    past = x
    for k in range(1, ORDER):
        past = np.r_[np.zeros(1, np.int32), past[:-1]]
        out |= np.where(place >= k, past, 0) << (BITS * k)
    return out


def _texts(part: pa.RecordBatch) -> list[str]:
    return [t or "" for t in part.column("text").to_pylist()]


def counts(docs: DataFrame) -> DataFrame:
    """(lang, code, n): how often each n-gram occurs in the texts of each language, over all rows of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = defaultdict(lambda: [np.zeros(0, np.int32), np.zeros(0, np.int64)])
        for batch in batches:
            for part in chunks(batch, "text"):
                langs, texts = part.column("lang").to_pylist(), _texts(part)
                for lang in set(langs):
                    x, starts = classes_of([t for t, v in zip(texts, langs, strict=True) if v == lang])
                    g = grams(x, starts)
                    whole = np.ones(g.size, bool)
                    whole[starts] = False  # the mark before a text is not predicted
                    code, n = np.unique(np.concatenate([held[lang][0], g[whole]]), return_inverse=True)
                    held[lang] = [code, np.bincount(n, np.concatenate([held[lang][1], np.ones(int(whole.sum()))]), code.size).astype(np.int64)]
        for lang, (code, n) in held.items():
            for a in range(0, code.size, 50_000):
                m = min(50_000, code.size - a)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * m), pa.array(code[a : a + m]), pa.array(n[a : a + m])], ["lang", "code", "n"])

    return docs.select("lang", "text").mapInArrow(run, "lang string, code int, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))


def _discount(n: np.ndarray) -> float:
    one, two = int((n == 1).sum()), int((n == 2).sum())
    return min(max(one / (one + 2 * two), 0.1), 0.95) if one + two else 0.5


class Model:
    """Log probabilities of all languages: n-grams in sorted arrays, lower orders and backoff weights by context."""

    def __init__(self, found: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs = sorted(found)
        lower = [self._lower(found[v][0]) for v in self.langs]
        self.codes = np.unique(np.concatenate([found[v][0] for v in self.langs])).astype(np.int32)
        self.low = np.stack([np.log(p) for p in lower], 1).astype(np.float32)  # by the last three classes
        self.back = np.zeros((CLASSES ** (ORDER - 1), len(self.langs)), np.float32)  # by the three before the last
        self.high = np.zeros((self.codes.size, len(self.langs)), np.float32)
        for k, v in enumerate(self.langs):
            code, n = found[v]
            d = _discount(n)
            context = code >> BITS
            total = np.bincount(context, n, CLASSES ** (ORDER - 1))
            kinds = np.bincount(context, minlength=CLASSES ** (ORDER - 1))
            weight = np.where(total > 0, d * kinds / np.maximum(total, 1), 1.0)
            self.back[:, k] = np.log(weight)
            p = weight[self.codes >> BITS] * lower[k][self.codes & (CLASSES ** (ORDER - 1) - 1)]
            own = np.searchsorted(self.codes, code)
            p[own] += np.maximum(n - d, 0) / total[context]
            self.high[:, k] = np.log(p)
        self.limit = np.full(len(self.langs), np.inf)  # cross-entropy beyond which a text is rejected
        self.key = uuid.uuid4().hex

    @staticmethod
    def _lower(code: np.ndarray) -> np.ndarray:
        """Kneser-Ney probabilities of the three lower orders, from distinct n-grams, over all triples of classes."""
        p = np.full(1, 1 / CLASSES)
        for order in range(1, ORDER):
            above = np.unique(code & ((1 << BITS * (order + 1)) - 1))  # distinct n-grams of one order more
            n = np.bincount(above & ((1 << BITS * order) - 1), minlength=CLASSES**order).astype(float)
            d = _discount(n[n > 0])
            by = n.reshape(-1, CLASSES)
            total = by.sum(1, keepdims=True)
            weight = np.where(total > 0, d * (by > 0).sum(1, keepdims=True) / np.maximum(total, 1), 1.0)
            below = p.reshape(-1, CLASSES) if order > 1 else np.full((1, CLASSES), p[0])
            below = np.tile(below, (by.shape[0] // below.shape[0], 1))
            p = (np.maximum(by - d, 0) / np.maximum(total, 1) + weight * below).reshape(-1)
        return p

    def _place(self) -> np.ndarray:
        """Places of the sorted array by code. A process keeps those of one model."""
        if self.key not in _PLACES:
            _PLACES.clear()
            _PLACES[self.key] = np.full(1 << BITS * ORDER, -1, np.int32)
            _PLACES[self.key][self.codes] = np.arange(self.codes.size)
        return _PLACES[self.key]

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cross-entropy of each text in each language by character, numbers of characters, and of letters."""
        x, starts = classes_of(texts)
        g = grams(x, starts)
        at = self._place()[g]
        logs = self.high[at]
        miss = np.flatnonzero(at < 0)
        logs[miss] = self.back[g[miss] >> BITS] + self.low[g[miss] & (CLASSES ** (ORDER - 1) - 1)]
        logs[starts] = 0
        n = np.diff(np.r_[starts, x.size]) - 1
        sums = np.add.reduceat(logs, starts, axis=0, dtype=np.float64)
        letters = np.add.reduceat((x > 0).astype(np.int64), starts)
        return -sums / np.maximum(n, 1)[:, None], n, letters

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language (und without a letter), a score from 0 to 1, and whether the text is unlike its language."""
        h, n, letters = self.entropies(texts)
        best = h.argmin(1)
        odds = np.exp(-np.minimum(n, 50)[:, None] * (h - h.min(1, keepdims=True)))  # as if of 50 characters at most
        score = np.where(letters > 0, 1 / odds.sum(1), 0.0)
        rejected = (letters == 0) | (h.min(1) > self.limit[best])
        return [self.langs[b] if m else "und" for b, m in zip(best.tolist(), letters.tolist(), strict=True)], score, rejected


def deviations(docs: DataFrame, model: Model) -> DataFrame:
    """(lang, n, m, s): texts of each language of at least 20 characters, mean and deviation of their own cross-entropies."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {v: k for k, v in enumerate(shared.value.langs)}
        held = np.zeros((len(place), 3))
        for batch in batches:
            for part in chunks(batch, "text", 1 << 20):
                h, size, _ = shared.value.entropies(_texts(part))
                at = np.array([place[v] for v in part.column("lang").to_pylist()])
                long = np.flatnonzero(size >= 20)
                at, x = at[long], h[long, at[long]]
                held += np.stack([np.bincount(at, w, len(place)) for w in (np.ones(x.size), x, x * x)], 1)
        some = np.flatnonzero(held[:, 0])
        if some.size:
            yield pa.RecordBatch.from_pydict({"lang": [shared.value.langs[k] for k in some], "n": held[some, 0].astype(np.int64), "h": held[some, 1], "hh": held[some, 2]})

    sums = docs.select("lang", "text").mapInArrow(run, "lang string, n long, h double, hh double").groupBy("lang").agg(F.sum("n").alias("n"), F.sum("h").alias("h"), F.sum("hh").alias("hh"))
    mean = F.col("h") / F.col("n")
    return sums.select("lang", "n", mean.alias("m"), F.sqrt(F.greatest(F.col("hh") / F.col("n") - mean * mean, F.lit(0.0))).alias("s"))


def limits(model: Model, found: list, width: float, few: int = FEW) -> np.ndarray:
    """Cross-entropy of each language beyond which a text is rejected, from rows of deviations().

    Mean and `width` deviations. A language with fewer than `few` texts has at least the loosest limit
    of those with more; if none has more, its limit is infinite, as is that of a language without texts.
    """
    own = {r["lang"]: r["m"] + width * r["s"] for r in found}
    loosest = max((own[r["lang"]] for r in found if r["n"] >= few), default=np.inf)
    own |= {r["lang"]: max(own[r["lang"]], loosest) for r in found if r["n"] < few}
    return np.array([own.get(v, np.inf) for v in model.langs])


def train(docs: DataFrame, width: float = 4.0) -> Model | None:
    """Models from all texts of the learning folds with a language; None if there are none.

    Counts, and the limits of rejection (mean and `width` deviations of cross-entropies in the own
    language), cover every learning document.
    """
    own = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold("doc_id", 3) != 1))
    found = counts(own).toArrow()
    if not found.num_rows:
        return None
    langs = found.column("lang").to_numpy(zero_copy_only=False).astype(str)
    code, n = (found.column(c).to_numpy() for c in ("code", "n"))
    grouped = {}
    for v in np.unique(langs).tolist():
        rows = np.flatnonzero(langs == v)
        rows = rows[np.argsort(code[rows])]
        grouped[v] = (code[rows], n[rows])
    model = Model(grouped)
    model.limit = limits(model, deviations(own, model).collect(), width)
    return model


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) for each row of docs.

    A text that is null or has no letter is `und` with score 0; so is every text if nothing could be learned.
    `rejected` marks those and texts unlike any learned language; lang_pred is the nearest all the same.
    """
    model = model or train(docs)
    held_out = F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out")
    if model is None:
        return docs.select("doc_id", held_out, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for part in chunks(batch, "text", 1 << 20):
                lang, score, rejected = own.predict(_texts(part))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(lang), pa.array(score), pa.array(rejected)], ["doc_id", "lang_pred", "score", "rejected"])

    found = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")
    return found.select("doc_id", held_out, "lang_pred", "score", "rejected")
