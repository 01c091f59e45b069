"""Ids of a word BPE tokenizer, each distinct word encoded once in a process."""

from __future__ import annotations

import os
import string
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer, pre_tokenizers

#: Words a process remembers; beyond, it starts anew (which changes no result).
WORDS = 800_000
#: Letters below this stay one letter when composed and lower-cased.
_LATIN = "\u0130"
_MARKS = string.punctuation.encode()
#: Words that go to the tokenizer in one string.
_TOGETHER = 128


class Memory:
    """The ids of the words that this process has met, in one row; `known` has each word's number."""

    def __init__(self, path: str):
        # A task has one core: the library's threads would only get in each other's way.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        # The same model for words of lower-case letters, on which the steps before it change nothing.
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ends = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids, self.stops, self.used = np.zeros(1 << 16, np.uint16 if len(self.ends) <= 1 << 16 else np.uint32), np.zeros(1 << 14, np.int64), 0

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The number of each of these different words; those that are new are encoded first."""
        get = self.known.get
        found = [get(w, -1) for w in words]
        new = [w for w, k in zip(words, found, strict=True) if k < 0]
        if new:
            if len(self.known) + 2 * len(new) > WORDS:
                self.forget()
                new = words
            self.learn(new)
            found = list(map(self.known.__getitem__, words))
        return np.array(found, np.int64)

    def learn(self, words: list[bytes]) -> None:
        """The tokenizer splits letters from marks, so a word of letters with ASCII marks after it is encoded as the two."""
        parts, wholes = {}, {}
        for w in words:
            stem = w.rstrip(_MARKS)
            if stem and len(stem) < len(w) and _plain(stem.decode()):
                parts[w] = (stem, w[len(stem) :])
                wholes[stem] = wholes[w[len(stem) :]] = None
            else:
                wholes[w] = None
        plain, other = [], []
        for w in wholes:
            if w not in self.known:
                (plain if _plain(w.decode()) else other).append(w)
        groups = [plain[i : i + _TOGETHER] for i in range(0, len(plain), _TOGETHER)]
        for group, e in zip(groups, self.plain.encode_batch_fast([b" ".join(g).decode().lower() for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, self.ids.dtype)
            # Each word of letters ends with a token that ends words.
            self.add(group, ids, np.nonzero(self.ends[ids])[0] + 1)
        found = [e.ids for e in self.tokenizer.encode_batch_fast([w.decode() for w in other], add_special_tokens=False)]
        self.add(other, np.array([i for ids in found for i in ids], self.ids.dtype), np.fromiter(map(len, found), np.int64, len(found)).cumsum())
        pair = np.array([self.known[x] for both in parts.values() for x in both], np.int64)
        ids, stops = self.laid_out(pair)
        self.add(list(parts), ids, stops[1::2])

    def laid_out(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these words in a row, and where each word's end."""
        stops = self.stops[number]
        sizes = stops - np.where(number > 0, self.stops[number - 1], 0)
        ends = sizes.cumsum()
        # From an id's place in the row to its place in the memory: one distance for each word.
        return self.ids[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(stops - ends, sizes)], ends

    def add(self, words: list[bytes], ids: np.ndarray, stops: np.ndarray) -> None:
        if len(stops) != len(words):
            raise RuntimeError("the tokenizer did not end each word")
        first = len(self.known)
        self.ids, self.stops = _grown(self.ids, self.used + len(ids)), _grown(self.stops, first + len(words))
        self.ids[self.used : self.used + len(ids)] = ids
        self.stops[first : first + len(words)] = self.used + stops
        self.used += len(ids)
        self.known.update(zip(words, range(first, first + len(words)), strict=True))


def _plain(word: str) -> bool:
    return word.isalpha() and max(word) < _LATIN


def _bytes(words: pa.StringArray) -> list[bytes]:
    if not len(words):
        return []
    data, at = words.buffers()[2].to_pybytes(), np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].tolist()
    return [data[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]


def _grown(x: np.ndarray, size: int) -> np.ndarray:
    return x if size <= len(x) else np.concatenate([x, np.zeros(max(size, 2 * len(x)) - len(x), x.dtype)])


@lru_cache(maxsize=2)
def _loaded(path: str) -> Memory:
    return Memory(path)


def encode_words(texts: pa.Array | list[str | None], path: str, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all whole texts in a row, without special tokens, as the tokenizer gives them, and where each text's end.

    The tokenizer splits at white space and lowers case, so a text's ids are those of its words in a row: Arrow splits
    and numbers the words, distinct ones are looked up, and their ids are laid out together. end_id, if given, follows
    each text's.
    """
    memory = _loaded(path)
    column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(column, "")))
    coded = split.flatten().dictionary_encode()
    ids, stops = memory.laid_out(memory.numbers(_bytes(coded.dictionary))[coded.indices.to_numpy()])
    bounds = split.offsets.to_numpy().astype(np.int64)
    ends = np.concatenate([[0], stops])[bounds[1:] - bounds[0]]
    if end_id is None:
        return ids, ends
    out = np.full(len(ids) + len(ends), end_id, np.uint32)
    mine = np.ones(len(out), bool)
    ends = ends + np.arange(1, len(ends) + 1)
    mine[ends - 1] = False
    out[mine] = ids
    return out, ends
