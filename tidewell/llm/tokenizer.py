"""Encoding of texts with a public byte-level BPE vocabulary.

A text is cut into words by the vocabulary's pattern, and each word is encoded by dynamic
programming over its prefixes: every prefix has exactly one last token in its BPE encoding,
namely the only token that ends there and is compatible with the last token of the prefix
before it. An automaton over the whole vocabulary gives the tokens that end at each byte; two
tokens are compatible if BPE, given their joined bytes, wouldn't merge across the border,
which is decided by undoing their merges. Back-pointers then give the ids. The time is
linear in the length of the word, however long it is, and no merge loop is run.

Words repeat, so each Python worker keeps the ids of the words it has met (`WORDS` at
most; then it starts again). The vocabulary file is read on the driver and broadcast: its
size is that of the file.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidewell.session import ship

#: Where the vocabulary lies, if the caller gives no path.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that cuts texts into words for this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words whose ids a worker keeps.
WORDS = 500_000


class PrefixEncoder:
    """Exact BPE ids of a word by dynamic programming over its prefixes."""

    def __init__(self, ranks: list[bytes]):
        """`ranks`: the bytes of each token in order of its id, which is the order of the merges."""
        import ahocorasick

        self.size = [len(t) for t in ranks]
        ids = {t: i for i, t in enumerate(ranks)}
        self.left, self.right = list(range(len(ranks))), list(range(len(ranks)))
        self.joined: dict[tuple[int, int], int] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.automaton = ahocorasick.Automaton()
        # Token by token in merge order, so that the parts of a token can be found with the tokens before it.
        for i, token in enumerate(ranks):
            if len(token) > 1:
                self.left[i], self.right[i] = self._halves(token, i, ids)
                self.joined[self.left[i], self.right[i]] = i
            self.automaton.add_word(token.decode("latin-1"), i)
        self.automaton.make_automaton()

    @staticmethod
    def _halves(token: bytes, limit: int, ids: dict[bytes, int]) -> tuple[int, int]:
        """The two tokens that merge into `token`: its merges run down until two parts are left."""
        parts = [token[k : k + 1] for k in range(len(token))]
        while len(parts) > 2:
            best, at = limit, -1
            for k in range(len(parts) - 1):
                r = ids.get(parts[k] + parts[k + 1], limit)
                if r < best:
                    best, at = r, k
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return ids[parts[0]], ids[parts[1]]

    def compatible(self, a: int, b: int) -> bool:
        """Whether BPE leaves the border between tokens a and b as it is.

        The merges of both are undone, latest first. At each step the two tokens at the border
        could merge; if that merge is earlier than the one just undone, BPE would have made it.
        """
        known = self.fits.get((a, b))
        if known is not None:
            return known
        x, y, bound, fine = a, b, len(self.size), True
        while True:
            m = self.joined.get((x, y))
            if m is not None and m < bound:
                fine = False
                break
            open_x, open_y = self.size[x] > 1, self.size[y] > 1
            if not (open_x or open_y):
                break
            # Equal tokens: the left occurrence is merged first, so the right one is undone first,
            # and until then a merge of the same rank across the border still comes first.
            if open_x and (x > y or not open_y):
                bound, x = x, self.right[x]
            else:
                bound, y = y + 1, self.left[y]
        if len(self.fits) > 2_000_000:
            self.fits.clear()
        self.fits[a, b] = fine
        return fine

    def encode(self, word: bytes) -> tuple[int, ...]:
        """Ids of one word; the empty word has none."""
        n = len(word)
        last = [-1] * (n + 1)
        size, fits = self.size, self.compatible
        for end, token in self.automaton.iter(word.decode("latin-1")):
            end += 1
            if last[end] < 0:
                start = end - size[token]
                if start == 0 or (last[start] >= 0 and fits(last[start], token)):
                    last[end] = token
        ids = []
        while n > 0:
            ids.append(last[n])
            n -= size[last[n]]
        return tuple(reversed(ids))


class _Words(dict):
    """Word -> ids, filled as words are met."""

    def __init__(self, encoder: PrefixEncoder):
        self.encoder = encoder

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= WORDS:
            self.clear()
        ids = self.encoder.encode(word.encode("utf-8", "replace"))
        if len(word) <= 64:
            self[word] = ids
        return ids


def read_ranks(content: bytes) -> list[bytes]:
    """Tokens by id from a vocabulary file of lines `base64 id`."""
    pairs = sorted((int(i), base64.b64decode(t)) for t, i in map(bytes.split, content.splitlines()) if t)
    return [t for _, t in pairs]


_LOADED: dict[int, _Words] = {}


def _words(content: bytes) -> _Words:
    """The encoder of this worker process."""
    key = hash(content)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = _Words(PrefixEncoder(read_ranks(content)))
    return _LOADED[key]


def encode_texts(df: DataFrame, text: str, keep: list[str], vocabulary: str = VOCABULARY, ids: str = "ids", count_only: bool = False) -> DataFrame:
    """The columns `keep` of `df` and the token ids of its column `text`.

    `ids` is array<int>; the empty text and null both give the empty list. With
    `count_only`, `n_tokens` (bigint) stands in its place. Whole texts are encoded. Rows
    stay where they are: no shuffle.
    """
    spark = df.sparkSession
    ship(spark)
    with open(vocabulary, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())
    rows = df.select(*keep, F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import regex

        words, pattern = _words(shared.value), regex.compile(PATTERN)
        get, find = words.__getitem__, pattern.findall
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            kept = [batch.column(k) for k in range(batch.num_columns - 1)]
            if count_only:
                counts = [sum(map(len, map(get, find(t)))) if t else 0 for t in texts]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(counts, pa.int64())], names=[*keep, "n_tokens"])
                continue
            flat: list[int] = []
            ends = [0]
            for t in texts:
                if t:
                    flat.extend(chain.from_iterable(map(get, find(t))))
                ends.append(len(flat))
            values = pa.array(np.array(flat, dtype=np.int32))
            lists = pa.ListArray.from_arrays(pa.array(np.array(ends, dtype=np.int32)), values)
            yield pa.RecordBatch.from_arrays([*kept, lists], names=[*keep, ids])

    kinds = dict(df.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "n_tokens bigint" if count_only else f"`{ids}` array<int>"])
    return rows.mapInArrow(run, schema)
