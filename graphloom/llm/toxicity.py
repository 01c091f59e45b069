"""Toxicity: averages of subword embeddings over short windows, a linear softmax, and the most toxic window decides."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sampling, subword
from .common import by_arrow, col, cut, lists, released, slices, unlisted

SIZES, BUCKETS, DIM, EPOCHS, RATE, SEED = (3, 4, 5), 1 << 17, 8, 14, 0.6, 12
#: Words of a window; windows begin every half of it.
WINDOW = 8
#: Rows of each label to learn from, at most, the bytes of their texts, likewise, and the code points of one run of a longer text that is learned from.
SAMPLE, SAMPLE_BYTES, PIECE = 1200, 8 << 20, 1 << 20
_TOGETHER = 1 << 18
#: Standard errors by which a log-odds ratio is drawn towards zero, and the softmax's first weight on it.
_SURE, _GAIN = 1.645, 3.0


def words_of(points: subword.Points) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first place, place after the last, bucket of the whole word) of each word in a row of points."""
    edge = np.diff(np.concatenate([[0], points.full.astype(np.int8), [0]]))
    first, after = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
    # A polynomial in an odd number that has an inverse modulo 2^64, so that sums of powers can be moved to the word's start.
    step = 0x9E3779B97F4A7C15
    with np.errstate(over="ignore"):
        powers = np.full(len(points.points), np.uint64(step))
        powers[:1] = 1
        powers = np.multiply.accumulate(powers)
        back = np.full(len(points.points), np.uint64(pow(step, -1, 1 << 64)))
        back[:1] = 1
        back = np.multiply.accumulate(back)
        sums = np.concatenate([[np.uint64(0)], np.add.accumulate(points.points.astype(np.uint64) * powers)])
        whole = (sums[after] - sums[first]) * back[first] if len(first) else np.zeros(0, np.uint64)
    return first, after, subword.bucket((whole ^ whole >> np.uint64(32)).astype(np.uint32), BUCKETS)


def word_bags(points: subword.Points) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, word) of every subword in the order of words, each word's first place, and whether it is muted.

    A word that is one of the WINDOW - 1 before it again is muted: it counts in an average's size, not in its sum, so
    that a word repeated all through a window weighs no more there than once.
    """
    first, _, whole = words_of(points)
    text, muted = np.searchsorted(points.starts, first, "right"), np.zeros(len(first), bool)
    for k in range(1, WINDOW):
        muted[k:] |= (whole[k:] == whole[:-k]) & (text[k:] == text[:-k])
    places, ids = [first], [whole]
    for n in SIZES:
        found, ok = points.grams(n, BUCKETS)
        at = np.nonzero(ok)[0]
        places.append(at)
        ids.append(found[at])
    place, ids = np.concatenate(places), np.concatenate(ids)
    # An n-gram that begins at the edge before a word belongs to it: its first full place is the next one.
    owner = np.searchsorted(first, place + ~points.full[place], "right") - 1
    order = np.argsort(owner, kind="stable")
    return ids[order], owner[order], first, muted


def windows(n_words: int, size: int = WINDOW) -> list[tuple[int, int]]:
    """Ranges of words, each `size` long or all there are, half overlapping, that cover the text."""
    half = size // 2
    return [(i, min(i + size, n_words)) for i in range(0, max(1, n_words - half), half)] if n_words else []


@dataclass(frozen=True)
class Model:
    """table: each bucket's part in the log-odds of a window; slope and shift make the top window's a probability."""

    table: np.ndarray
    slope: float
    shift: float

    def odds(self, texts: list[str | None]) -> np.ndarray:
        """The largest log-odds of any window of each whole text; those of no evidence for a text without a word."""
        out = []
        for i, j in slices([len(t or "") for t in texts], _TOGETHER):
            points = subword.Points(texts[i:j], subword.inside_words())
            ids, owner, first, muted = word_bags(points)
            n = len(first)
            sums, counts = np.bincount(owner, np.where(muted[owner], 0, self.table[ids]), minlength=n), np.bincount(owner, minlength=n)
            text = np.searchsorted(points.starts, first, "right") - 1
            total = np.concatenate([[0.0], sums.cumsum()])
            number = np.concatenate([[0], counts.cumsum()])
            begin = np.searchsorted(text, np.arange(j - i), "left")
            end = np.searchsorted(text, np.arange(j - i), "right")
            at = np.arange(n)
            local = at - begin[text]
            half = WINDOW // 2
            starts = at[(local % half == 0) & ((local == 0) | (local < end[text] - begin[text] - half))]
            stops = np.minimum(starts + WINDOW, end[text[starts]])
            mean = (total[stops] - total[starts]) / np.maximum(number[stops] - number[starts], 1)
            top = np.full(j - i, -np.inf)
            np.maximum.at(top, text[starts], mean)
            out.append(top)
        return np.concatenate(out) if out else np.zeros(0)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        odds = self.odds(texts)
        z = np.where(np.isfinite(odds), self.slope * odds + self.shift, min(self.shift, -4.0))
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """A model from the rows of docs whose id has a label, 0 or 1, in labels; null ids have none, null texts are left out.

    Up to `sample` rows of each label are drawn by a hash of (id, text), alike ones once; only ids, hashes and sizes meet
    the labels, and then the drawn rows' texts are fetched. No text is left out for its length: of one longer than PIECE
    a run is learned from. The driver gets their subwords by word, and trains
    in numpy: embeddings and softmax take a step for one window at a time. A toxic document has some toxic window, a
    clean one has none, so in each round a toxic document gives the window that then looks most toxic, and a clean one
    its three most toxic and three others. Training starts from embeddings that hold, in one coordinate, how much more
    often a subword occurs in documents of one label, so that the first windows are well chosen. One row in five is kept back to turn the top window's log-odds into a probability, weighted so
    that both labels count as often as in all rows. Without rows of both labels, all scores are those of no evidence.
    """
    good = docs.where(col(text_col).isNotNull())
    keyed = good.select(col(id_col).alias("id"), sampling.key(id_col, text_col).alias("at"), F.least(F.octet_length(col(text_col)), F.lit(4 * PIECE)).alias("size"))
    marked = labels.where(col(label_col).isin(0, 1)).select(col(id_col).alias("id"), col(label_col).cast("int").alias("label")).distinct()
    pool = cut(keyed.join(marked, "id").select("label", "at", "size"))
    counts = {r["label"]: r["n"] for r in pool.groupBy("label").agg(F.count("*").alias("n")).collect()}
    none = Model(np.zeros(BUCKETS, np.float32), 1.0, -4.0)
    if len(counts) < 2:
        return none

    def bag(label, text, at):
        ids, heard, sizes = [], [], []
        for t, k in zip(text, at, strict=True):
            i, owner, first, muted = word_bags(subword.Points([sampling.piece(t, k, PIECE)], subword.inside_words()))
            sizes.append(np.bincount(owner, minlength=len(first)))
            ids.append(i[~muted[owner]])
            heard.append(np.where(muted, 0, sizes[-1]))
        return [pa.array(label, pa.int32()), at, lists(ids), lists(heard), lists(sizes)]

    got = sampling.taken(good, sampling.draw(pool, sample, SAMPLE_BYTES), "int", bag, "label int, at long, ids array<int>, heard array<int>, sizes array<int>", id_col, text_col)
    model = fit(got, counts, none)
    del got
    released()
    return model


def fit(got: pa.Table, counts: dict[int, int], none: Model, start: bool = True) -> Model:
    """The model from drawn rows (label, ids, heard, sizes) and the number of all rows of each label; `none` if both labels aren't there. start: see train."""
    labels = np.array(got["label"].to_pylist())
    ids = [a for c in got["ids"].chunks for a in unlisted(c)]
    # Where each word's subwords end among those that are heard, and among all.
    ends, sizes = ([np.concatenate([[0], s.cumsum()]).astype(np.int64) for c in got[name].chunks for s in unlisted(c)] for name in ("heard", "sizes"))
    full = [k for k in range(len(ids)) if len(ids[k])]
    held = full[::5] if len(full) >= 50 else []
    learn = np.array(sorted(set(full) - set(held)))
    if len(set(labels[learn].tolist())) < 2:
        return none
    model, rng = subword.Embeddings(BUCKETS, 2, DIM, SEED), np.random.default_rng(SEED)

    if start:
        _start(model, [ids[k] for k in learn], labels[learn])

    def tops(k: int, table: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray]:
        spans = windows(len(ends[k]) - 1)
        total = np.concatenate([[0.0], table[ids[k]].cumsum(dtype=np.float64)])
        a, b = np.array(spans).T
        return spans, (total[ends[k][b]] - total[ends[k][a]]) / np.maximum(sizes[k][b] - sizes[k][a], 1)

    for epoch in range(EPOCHS):
        rate, t = RATE * (1 - epoch / EPOCHS), model.table()
        table = t[:, 1] - t[:, 0]
        for k in rng.permutation(learn).tolist():
            spans, odds = tops(k, table)
            best = np.argsort(-odds, kind="stable")[: 1 if labels[k] else 3].tolist()
            chosen = [spans[i] for i in best] + ([] if labels[k] else [spans[i] for i in rng.integers(len(spans), size=3).tolist()])
            for a, b in chosen:
                part, n = np.unique(ids[k][ends[k][a] : ends[k][b]], return_counts=True)
                model.step(part, n, int(labels[k]), rate, int(sizes[k][b] - sizes[k][a]))
    t = model.table()
    table = (t[:, 1] - t[:, 0]).astype(np.float32)
    if not held:
        return Model(table, 1.0, 0.0)
    top = np.array([tops(k, table)[1].max() for k in held])
    drawn_of = {x: max(1, int((labels == x).sum())) for x in (0, 1)}
    weight = np.array([counts[int(labels[k])] / drawn_of[int(labels[k])] for k in held])
    return Model(table, *_logistic(top, labels[held], weight / weight.sum()))


def _start(model: subword.Embeddings, texts: list[np.ndarray], labels: np.ndarray) -> None:
    """Lays each subword's log-odds ratio of document frequencies, as far as it is sure of its sign, into the first coordinate."""
    seen = np.zeros((2, BUCKETS))
    for ids, label in zip(texts, labels.tolist(), strict=True):
        seen[label, np.unique(ids)] += 1
    total = np.bincount(labels, minlength=2)
    ratio = np.log((seen[1] + 0.5) / (total[1] + 1)) - np.log((seen[0] + 0.5) / (total[0] + 1))
    doubt = _SURE * np.sqrt(1 / (seen[1] + 0.5) + 1 / (seen[0] + 0.5))
    model.e *= 0.1
    model.e[:, 0] = np.sign(ratio) * np.maximum(np.abs(ratio) - doubt, 0)
    model.w[:, 0] = (-_GAIN, _GAIN)
    model.b[:] = (1.0, -1.0)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift that make y likeliest, with a little pull towards small slopes; by Newton's method."""
    scale = float(np.abs(x).mean()) or 1.0
    a = np.stack([x / scale, np.ones_like(x)], axis=1)
    w = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        grad = a.T @ (weight * (p - y)) + 1e-3 * np.array([w[0], 0])
        hess = (a * (weight * p * (1 - p))[:, None]).T @ a + np.diag([1e-3, 1e-9])
        move = np.linalg.solve(hess, grad)
        w -= move * min(1.0, 2.0 / max(np.abs(move).max(), 1e-9))
    return float(w[0] / scale), float(w[1])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (doc_id, score, predicted) for each row of docs; only the text is looked at.

    Null and empty texts and those without a word have a low score, that of no evidence. Repeated rows give a row
    each; other columns are not read; an empty table gives none.
    """
    rows = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"))

    def run(doc_id, text):
        s = model.scores(text.to_pylist())
        return doc_id, s.tolist(), (s >= 0.5).astype(np.int32).tolist()

    return by_arrow(rows, ["doc_id", "text"], run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double, predicted int")
