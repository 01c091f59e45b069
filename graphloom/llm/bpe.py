"""Byte-level BPE: whole texts to token ids and back, long texts in overlapping chunks."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, by_arrow, by_batch, col, lists, partitions, unlisted

#: Code points of a chunk, and of the overlap in which two chunks must meet. A pre-token may look this far past its end.
CHUNK, OVERLAP, AHEAD = 32_768, 1_024, 3
#: Ids of a text that are written out together to be digested.
_PART = 1 << 16


@lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks(path), special_tokens={})


@lru_cache(maxsize=4)
def raw(path: str) -> np.ndarray:
    """Each rank's bytes; None for a rank that isn't there."""
    out = np.full(max(ranks(path).values()) + 1, None, object)
    for token, rank in ranks(path).items():
        out[rank] = token
    return out


@lru_cache(maxsize=2)
def _decimal(upto: int) -> np.ndarray:
    return np.array([b"%d" % i for i in range(upto)], object)


def boundaries(body: str, pattern: str, ends: bool) -> list[int]:
    """Where pre-tokens of body begin, 0 first. Unless the text ends with body, places that more text could move are left out."""
    found = [m.start() for m in _compiled(pattern).finditer(body)]
    return found if ends else [b for b in found if b + AHEAD <= len(body)]


@lru_cache(maxsize=4)
def _compiled(pattern: str):
    # White space as the encoder's library has it.
    return regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


def chunks(text: str, chunk: int, overlap: int) -> list[tuple[int, str, bool]]:
    """(start, body, whether the text ends with it); each body runs `overlap` into the next."""
    starts = range(0, max(1, len(text)), chunk)
    return [(s, text[s : s + chunk + overlap], s + chunk >= len(text)) for s in starts]


def edges(body: str, first: bool, last: bool, pattern: str, chunk: int, overlap: int) -> tuple[list[int], list[int]]:
    """The boundaries in the overlap with the chunk before, and in that with the chunk after, from body's start.

    Those after white space are left out: a piece that ends with it would be split unlike the same text going on.
    """
    found = [b for b in boundaries(body, pattern, last) if b and not body[b - 1].isspace()]
    return ([0] if first else [b for b in found if b < overlap]), ([] if last else [b for b in found if chunk <= b < chunk + overlap])


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP, into: tuple[Callable[[list[np.ndarray]], list], str] = (lambda ids: [lists(ids)], "ids array<int>")) -> DataFrame:
    """One row (doc_id, ids) for each row of docs: the token ids of its whole text.

    `into` makes other columns of the ids in the same pass: a function from the arrays of ids of some documents to
    columns, and their schema.

    A text of up to `chunk` code points is one chunk. Longer texts are cut into chunks that overlap. Every chunk is
    pre-tokenised on its own, from a place that may lie inside a pre-token. Matching looks at nothing before its
    start, so from the first boundary that two neighbours share in their overlap they go on alike: there the text is
    stitched, and each piece between two stitches is encoded on its own, in any task. By induction from the first
    chunk, whose start is a true boundary, each stitch is one too, so the ids are those of the whole text. Where two
    neighbours share none (a run without any boundary longer than the overlap), that text is encoded as a whole.

    Equal long texts are encoded once. Nulls count as empty and empty texts have no ids; null ids, repeated rows and
    repeated ids keep their rows; other columns are not read. An empty table gives none.
    """
    docs = docs.select(col(id_col).alias("doc_id"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    long = F.length("text") > chunk
    bounded(docs.sparkSession)

    def ids_of(text: str) -> np.ndarray:
        return np.array(encoding(ranks_path, pattern).encode_ordinary(text), np.int32)

    make, schema = into

    def whole(doc_id, text):
        return doc_id, *make([ids_of(t) for t in text.to_pylist()])

    short = by_arrow(docs.where(~long), ["doc_id", "text"], whole, f"doc_id {id_type}, {schema}")
    parts = partitions(docs.sparkSession)
    texts = docs.where(long).select(F.sha2("text", 256).alias("digest"), "text").dropDuplicates(["digest"])

    def cut_up(batches):
        for b in batches:
            for digest, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for k, (start, body, last) in enumerate(chunks(text, chunk, overlap)):
                    yield pa.RecordBatch.from_pydict({"digest": [digest], "k": pa.array([k], pa.int32()), "body": [body], "last": [last]})

    def look(digest, k, body, last):
        found = [edges(b, not i, z, pattern, chunk, overlap) for i, b, z in zip(k, body, last, strict=True)]
        return digest, k, body, last, [[i * chunk + x for x in h] for i, (h, _) in zip(k, found, strict=True)], [[i * chunk + x for x in t] for i, (_, t) in zip(k, found, strict=True)]

    cuts = texts.mapInArrow(cut_up, "digest string, k int, body string, last boolean").repartition(parts, "digest", "k")
    cuts = by_batch(cuts, ["digest", "k", "body", "last"], look, "digest string, k int, body string, last boolean, head array<long>, tail array<long>")
    along = Window.partitionBy("digest").orderBy("k")
    stitch = F.when(F.col("k") == 0, F.lit(0)).otherwise(F.array_min(F.array_intersect(F.lag("tail").over(along), "head")))
    cuts = cuts.withColumn("from", stitch)
    cuts = cuts.withColumn("upto", F.lead("from").over(along)).withColumn("meets", F.col("from").isNotNull() & (F.col("last") | F.col("upto").isNotNull()))

    def encode_piece(digest, k, body, start, upto, meets):
        out = []
        for i, b, s, u, m in zip(*(c.to_pylist() for c in (k, body, start, upto, meets)), strict=True):
            out.append(ids_of(b[s - i * chunk : None if u is None else u - i * chunk]) if m else None)
        return digest, k, lists(out)

    pieces = by_arrow(cuts.repartition(parts, "digest", "k"), ["digest", "k", "body", "from", "upto", "meets"], encode_piece, "digest string, k int, ids array<int>")
    pieces = pieces.groupBy("digest").agg(F.array_sort(F.collect_list(F.struct("k", "ids"))).alias("p"), F.bool_and(F.col("ids").isNotNull()).alias("met"))
    stitched = pieces.select("digest", "met", F.when(F.col("met"), F.flatten(F.transform("p", lambda x: x["ids"]))).alias("ids"))
    mine = docs.where(long).select("doc_id", F.sha2("text", 256).alias("digest"), "text")
    mine = mine.join(stitched, "digest").select("doc_id", F.when(~F.col("met"), F.col("text")).alias("text"), "ids")

    def rest(doc_id, text, ids):
        return doc_id, *make([i if t is None else ids_of(t) for t, i in zip(text.to_pylist(), unlisted(ids), strict=True)])

    return short.unionByName(by_arrow(mine, ["doc_id", "text", "ids"], rest, f"doc_id {id_type}, {schema}"))


def decode(tokens: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row (doc_id, ids, bytes) for each row of tokens: the tokens' raw bytes joined. Null for null ids or an id that isn't in the vocabulary."""
    t = tokens.select(col(id_col).alias("doc_id"), col(ids_col).alias("ids"))

    def join(doc_id, ids):
        return doc_id, ids, [decoded(i, ranks_path) for i in unlisted(ids)]

    return by_arrow(t, ["doc_id", "ids"], join, f"doc_id {t.schema['doc_id'].dataType.simpleString()}, ids array<int>, bytes binary")


def decoded(ids: np.ndarray | None, ranks_path: str) -> bytes | None:
    table = raw(ranks_path)
    if ids is None or len(ids) and not 0 <= ids.min() <= ids.max() < len(table):
        return None
    tokens = table[ids].tolist()
    return None if None in tokens else b"".join(tokens)


def digests(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row of docs: its whole text is encoded, the ids are decoded, and both are digested.

    All in the tasks that encode, so ids aren't sent from one Python process to the next. Nulls, empty tables and so on
    as in encode().
    """

    def digested(ids: list[np.ndarray]) -> list:
        names = _decimal(len(raw(ranks_path)))
        said, back = [], []
        for i in ids:
            a, b = hashlib.sha256(), hashlib.sha256()
            for k in range(0, len(i), _PART):
                part = i[k : k + _PART]
                a.update(b" " * bool(k) + b" ".join(names[part].tolist()))
                b.update(decoded(part, ranks_path))
            said.append(a.hexdigest())
            back.append(b.hexdigest())
        return [[len(i) for i in ids], said, back]

    return encode(docs, ranks_path, pattern, id_col, text_col, into=(digested, "n_tokens long, ids_sha256 string, decoded_sha256 string"), **how)
