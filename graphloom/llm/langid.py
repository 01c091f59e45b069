"""Language identification: averaged hashed subword embeddings, a linear softmax, and calibrated rejection."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import sampling, subword
from .common import by_arrow, col, cut, fresh, lists, released, slices, through, unlisted

SIZES, BUCKETS, DIM, EPOCHS, RATE, SEED = (1, 2, 3, 4), 1 << 14, 16, 6, 0.5, 11
#: Rows to learn from, at most, shared equally among the languages, but FLOOR of each; the bytes of their texts, likewise;
#: and the code points of one run of a longer text that is learned from.
SAMPLE, FLOOR, SAMPLE_BYTES, PIECE = 4000, 100, 16 << 20, 1 << 16
#: Documents in so many are rejected of those in a known language, in the calibration part, and the confidence that always suffices.
REJECT, ENOUGH = 0.001, 0.5
#: Evidence for a language: n-grams of the LONGER sizes by KNOWN buckets, each counted ONCE more than it was seen.
LONGER, KNOWN, ONCE = (3, 4), 1 << 16, 0.5
#: How often a row of a rare language is shown in a round, at most.
AGAIN = 50
UNKNOWN = "und"
#: Code points that are looked at together.
_TOGETHER = 1 << 18


@dataclass(frozen=True)
class Model:
    """langs in code-point order; table has a row of logits for each bucket.

    A softmax is sure of text unlike all it has learned from, so it is rejected by evidence: `known` has the log-probability
    of each bucket's n-grams in each language; a text's mean in its language, less the usual one (`centre`), must not be below
    the language's `limit`.
    """

    langs: tuple[str, ...]
    table: np.ndarray
    scale: float
    least: float
    known: np.ndarray
    centre: np.ndarray
    limit: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score, rejected) of each whole text. A text without a letter is UNKNOWN, with score 0, and rejected; of equal scores the first language counts."""
        langs, scores, rejected = [], [], []
        for i, j in slices([len(t or "") for t in texts], _TOGETHER):
            points = subword.Points(texts[i:j], subword.letters())
            p = subword.softmax(self.scale * subword.means(points, SIZES, self.table)) if self.langs else np.zeros((j - i, 1))
            any_letter = np.logical_or.reduceat(points.full, points.starts) & bool(self.langs)
            best = p.argmax(axis=1)
            score = np.where(any_letter, p[np.arange(j - i), best], 0.0)
            langs += [self.langs[b] if k else UNKNOWN for b, k in zip(best.tolist(), any_letter.tolist(), strict=True)]
            scores.append(score)
            stray = subword.means(points, LONGER, self.known)[np.arange(j - i), best] - self.centre[best]
            rejected.append((score < self.least) | (stray < self.limit[best]))
        empty = [np.zeros(0)]
        return langs, np.concatenate(empty + scores), np.concatenate([np.zeros(0, bool), *rejected])


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """A model of the languages in labelled rows: null languages and texts are left out.

    Up to `sample` rows are drawn by a hash of (id, text), as many of each language, so a rare one is learned too;
    rows alike in both count once, null ids like others. Texts are not left out for their length: of one longer than PIECE a
    run is learned from. Executors turn them into bags of hashed n-grams, whose size is bounded by the number of
    buckets; the driver trains on these in numpy, and shows those of rare languages more often. One in five of each
    language's rows is kept back to calibrate: the temperature makes scores match how often they are right there, the
    least score to accept is the one that REJECT of the kept rows miss, or ENOUGH if that is lower, and the least
    evidence is what REJECT of them miss. A language of fewer than 10 rows keeps none back: its usual evidence is that
    of each of its rows under the others, and a text is not rejected that has as much as the least of these. With fewer
    than 50 rows in all nothing is kept back and evidence rejects nothing. Without rows the model knows no language.
    """
    good = labelled.where(col(text_col).isNotNull() & col(lang_col).isNotNull()).withColumn(lang := fresh(labelled, "lang"), col(lang_col).cast("string"))
    pool = good.select(F.col(lang).alias("label"), sampling.key(id_col, text_col).alias("at"), F.least(F.octet_length(col(text_col)), F.lit(4 * PIECE)).alias("size"))
    pool = cut(pool)
    languages = pool.select("label").distinct().count()
    each = lambda most, least: max(least, most // max(languages, 1))
    drawn = sampling.draw(pool, each(sample, min(FLOOR, sample)), each(SAMPLE_BYTES, SAMPLE_BYTES // 64))

    def bag(lang, text, at):
        points = subword.Points([sampling.piece(t, k, PIECE) for t, k in zip(text, at, strict=True)], subword.letters())
        shorter = subword.bags(points, tuple(n for n in SIZES if n not in LONGER), BUCKETS)
        # Those of the LONGER sizes first, by KNOWN buckets; the others after these.
        found = [(np.append(i, j + KNOWN), np.append(n, m)) for (i, n), (j, m) in zip(subword.bags(points, LONGER, KNOWN), shorter, strict=True)]
        return [lang, at, lists([ids for ids, _ in found]), lists([n for _, n in found])]

    got = sampling.taken(good, drawn, "string", bag, "label string, at long, ids array<int>, counts array<int>", id_col, text_col)
    model = fit(got)
    del got
    released()
    return model


def fit(got: pa.Table) -> Model:
    """The model from drawn rows (label, at, ids, counts)."""
    langs = tuple(sorted(set(got["label"].to_pylist())))
    place = {x: k for k, x in enumerate(langs)}
    labels = np.array([place[x] for x in got["label"].to_pylist()], np.int64)
    fine = list(zip(_arrays(got["ids"]), _arrays(got["counts"]), strict=True))
    bags = [_coarse(i, c) for i, c in fine]
    full = [k for k in range(len(bags)) if len(bags[k][0])]
    if not full:
        return Model((), np.zeros((BUCKETS, 1)), 1.0, 0.0, np.zeros((KNOWN, 1)), np.zeros(1), np.full(1, -np.inf))
    of = [[k for k in full if labels[k] == x] for x in range(len(langs))]
    held = [k for mine in of if len(full) >= 50 and len(mine) >= 10 for k in mine[::5]]
    kept = set(held)
    learn = [[k for k in mine if k not in kept] for mine in of]
    most = max(map(len, learn))
    shown = np.array([k for mine in learn for k in mine * max(1, min(AGAIN, most // (4 * max(len(mine), 1))))])
    model = subword.Embeddings(BUCKETS, len(langs), DIM, SEED)
    for epoch in range(EPOCHS):
        for k in model.rng.permutation(shown).tolist():
            model.step(*bags[k], labels[k], RATE * (1 - epoch / EPOCHS))
    table = model.table().astype(np.float32)
    logits = np.array([(c / c.sum()) @ table[i] for i, c in (bags[k] for k in held)]).reshape(-1, len(langs))
    scale = subword.temperature(logits, labels[held]) if held else 1.0
    top = subword.softmax(scale * logits).max(axis=1) if held else np.ones(1)
    longer = [(i[i < KNOWN], c[i < KNOWN]) for i, c in fine]
    seen = np.full((KNOWN, len(langs)), ONCE)
    for mine in learn:
        for k in mine:
            seen[longer[k][0], labels[k]] += longer[k][1]
    known = np.log(seen / seen.sum(axis=0)).astype(np.float32)
    centre, limit = np.zeros(len(langs)), np.full(len(langs), -np.inf)
    if held:
        evidence = {k: float(np.average(known[longer[k][0], labels[k]], weights=longer[k][1])) for k in held if len(longer[k][0])}
        for x, mine in enumerate(of):
            if any(k in evidence for k in mine):
                centre[x] = np.median([evidence[k] for k in mine if k in evidence])
        usual = float(np.quantile([e - centre[labels[k]] for k, e in evidence.items()], REJECT)) if evidence else -np.inf
        for x, mine in enumerate(of):
            if any(k in evidence for k in mine):
                limit[x] = usual
            elif len(alone := [e for k in mine if len(longer[k][0]) for e in [_without(seen[:, x], *longer[k])]]) > 1:
                centre[x] = np.median(alone)
                limit[x] = min(usual, min(alone) - centre[x])
    return Model(langs, table, scale, float(min(ENOUGH, np.quantile(top, REJECT))), known, centre, limit)


def _without(seen: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> float:
    """The evidence of a row under the counts without its own."""
    return float(np.average(np.log((seen[ids] - counts) / (seen.sum() - counts.sum())), weights=counts))


def _coarse(ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same bag by BUCKETS, which are the low bits of KNOWN."""
    out, at = np.unique(ids & BUCKETS - 1, return_inverse=True)
    return out, np.bincount(at, counts, len(out)).astype(np.float32)


def _arrays(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [a for c in column.chunks for a in unlisted(c)]


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (doc_id, lang_pred, score, rejected) for each row of docs; only the text is looked at.

    Null and empty texts and those without a letter are UNKNOWN with score 0, and rejected. Repeated rows give a row
    each; other columns are not read; an empty table gives none.
    """
    rows = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"))

    def run(doc_id, text):
        langs, scores, rejected = model.predict(text.to_pylist())
        return doc_id, langs, scores.tolist(), [not s > 0 or bool(r) for s, r in zip(scores.tolist(), rejected.tolist(), strict=True)]

    return by_arrow(rows, ["doc_id", "text"], run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, rejected boolean")


def accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs whose text the model doesn't reject, as they are, all columns included."""
    place = docs.columns.index(text_col)

    def keep(b: pa.RecordBatch) -> list[pa.Array]:
        _, scores, rejected = model.predict(b.column(place).to_pylist())
        return list(b.filter(pa.array((scores > 0) & ~rejected)).columns)

    return through(docs, keep)


def remainder(doc_id: Column, of: int) -> Column:
    """crc32 of the id as text, modulo `of`; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")), F.lit(of))
