"""Token ids of whole corpora by a public byte-level BPE vocabulary.

Words (the pieces a text is split into before merging) never merge with each other,
and none crosses from a mark to white space, so a text is cut into segments (white
space and what follows up to the next) and each distinct segment is encoded once.
All new words of a block of documents are laid in one row of symbols; an inverted
index leads from a pair of neighbouring symbols to its places, and the merges are
replayed over all words in rank order, each touching only its places and their
neighbours.
"""

from __future__ import annotations

import base64
import heapq
import os
import re
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

TOKENIZERS = "/opt/tokenizers"
#: Fixed value: the public word pattern of byte_bpe_50k.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# The word pattern's white space is that of the standard library but for four separators.
_SPACE = r"[^\S\x1c-\x1f]"
SEGMENT = re.compile(rf"{_SPACE}*[\S\x1c-\x1f]+|{_SPACE}+")
#: A worker forgets its words when it holds this many bytes of them.
CACHE_BYTES = 32 << 20
BLOCK_CHARS = 4 << 20


class MergeReplay:
    """Encodes words by replaying the merges of a vocabulary of ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {r: b for b, r in ranks.items()}
        self.single = [ranks[bytes([i])] for i in range(256)]
        self.pairs: dict[tuple[int, int], int | None] = {}
        self.words: dict[str, tuple[int, ...]] = {}
        self.segments: dict[str, tuple[int, ...]] = {}
        self.held = 0
        self.split = regex.compile(PATTERN).findall

    @classmethod
    def load(cls, path: str) -> MergeReplay:
        """From a file of lines: base64 of the token's bytes, its rank."""
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def merged(self, pair: tuple[int, int]) -> int | None:
        """The symbol that ``pair`` merges into, if any."""
        if pair in self.pairs:
            return self.pairs[pair]
        to = self.ranks.get(self.bytes_of[pair[0]] + self.bytes_of[pair[1]])
        if len(self.pairs) < 1 << 20:
            self.pairs[pair] = to
        return to

    def replay(self, words: Sequence[str]) -> list[tuple[int, ...]]:
        """Ids of each word; ``words`` are one block with one index."""
        sym: list[int] = []
        left: list[int] = []
        right: list[int] = []
        starts = []
        for word in words:
            at = len(sym)
            starts.append(at)
            own = [self.single[b] for b in word.encode("utf-8", "surrogatepass")]
            sym += own
            left += [-1, *range(at, at + len(own) - 1)]
            right += [*range(at + 1, at + len(own)), -1]
        places: dict[tuple[int, int], list[int]] = {}
        for at, after in enumerate(right):
            if after >= 0:
                pair = (sym[at], sym[after])
                if pair in places:
                    places[pair].append(at)
                elif self.merged(pair) is not None:
                    places[pair] = [at]
        queue = [(self.merged(p), p) for p in places]
        heapq.heapify(queue)
        while queue:
            to, pair = heapq.heappop(queue)
            a, b = pair
            for at in sorted(places.pop(pair)):
                after = right[at]
                if after < 0 or sym[at] != a or sym[after] != b:
                    continue  # an earlier merge took one of the two
                beyond, before = right[after], left[at]
                sym[at], sym[after] = to, -1
                right[at], right[after] = beyond, -1
                if beyond >= 0:
                    left[beyond] = at
                for start, new in ((before, (sym[before], to)), (at, (to, sym[beyond]))):
                    if start < 0 or right[start] < 0:
                        continue
                    if new in places:
                        places[new].append(start)
                    elif (rank := self.merged(new)) is not None:
                        places[new] = [start]
                        heapq.heappush(queue, (rank, new))
        ends = [*starts[1:], len(sym)]
        return [tuple(x for x in sym[a:b] if x >= 0) for a, b in zip(starts, ends, strict=False)]

    def encode(self, texts: Sequence[str | None]) -> Iterator[list[int]]:
        """Ids of each text, in order; null and empty texts have none."""
        for cut in self._cut(texts):
            find = self.segments.__getitem__
            for segments in cut:
                yield list(chain.from_iterable(map(find, segments)))

    def count(self, texts: Sequence[str | None]) -> Iterator[int]:
        """The number of ids of each text."""
        for cut in self._cut(texts):
            sizes = {x: len(self.segments[x]) for xs in cut for x in xs}
            find = sizes.__getitem__
            for segments in cut:
                yield sum(map(find, segments))

    def _cut(self, texts: Sequence[str | None]) -> Iterator[list[list[str]]]:
        """The segments of each text, a block of texts at a time, all of them encoded."""
        for block in blocks(texts):
            cut = [SEGMENT.findall(t) if t else [] for t in block]
            new = [x for x in dict.fromkeys(x for xs in cut for x in xs) if x not in self.segments]
            split = [self.split(x) for x in new]
            words = [w for w in dict.fromkeys(w for ws in split for w in ws) if w not in self.words]
            self.words.update(zip(words, self.replay(words), strict=True))
            self.held += sum(100 + 9 * len(w) for w in words) + sum(100 + 9 * len(x) for x in new)
            find = self.words.__getitem__
            self.segments.update((x, tuple(chain.from_iterable(map(find, ws)))) for x, ws in zip(new, split, strict=True))
            yield cut
            if self.held > CACHE_BYTES:
                self.words, self.segments, self.held = {}, {}, 0


class PieceCounter:
    """Counts the pieces of a sentencepiece model.

    Where no piece of the model has a space mark after another character, and its
    normalisation only marks spaces, no piece reaches from one word into the next:
    then each distinct word (with the spaces before it) is encoded once.  Other
    models encode whole texts.
    """

    MARK = "\u2581"

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        m, mark = self.model, self.MARK
        crossing = re.compile(f"[^{mark}]{mark}")
        whole = any(crossing.search(m.id_to_piece(i)) for i in range(m.get_piece_size()))
        plain = all(m.normalize(x) == mark + x.replace(" ", mark) for x in ("  a  b ", "\ufb01\u2460\n\tA", "e\u0301"))
        self.by_word = plain and not whole
        self.sizes: dict[str, int] = {}
        self.held = 0

    def count(self, texts: Sequence[str | None]) -> Iterator[int]:
        for block in blocks(texts):
            if not self.by_word:
                yield from (len(x) for x in self.model.encode([t or "" for t in block], num_threads=1))
                continue
            cut = [self._words(t) if t else [] for t in block]
            new = [x for x in dict.fromkeys(x for xs in cut for x in xs) if x not in self.sizes]
            # A model marks the start of what it is given as it marks a space.
            made = self.model.encode([x[1:] for x in new], num_threads=1)
            self.sizes.update((x, len(ids) if len(x) > 1 else 1) for x, ids in zip(new, made, strict=True))
            self.held += sum(100 + 2 * len(x) for x in new)
            find = self.sizes.__getitem__
            yield from (sum(map(find, xs)) for xs in cut)
            if self.held > CACHE_BYTES:
                self.sizes, self.held = {}, 0

    _word = re.compile(" +[^ ]*")

    def _words(self, text: str) -> list[str]:
        return self._word.findall(" " + text.replace(self.MARK, " "))


def blocks(texts: Sequence[str | None]) -> Iterator[list[str | None]]:
    """``texts`` in runs of about ``BLOCK_CHARS`` characters, no text divided."""
    block: list[str | None] = []
    size = 0
    for t in texts:
        block.append(t)
        size += len(t or "")
        if size > BLOCK_CHARS:
            yield block
            block, size = [], 0
    if block:
        yield block


_loaded: dict[str, MergeReplay] = {}


def encoder(path: str) -> MergeReplay:
    """The worker's encoder of a vocabulary file; its words stay for later tasks."""
    if path not in _loaded:
        _loaded[path] = MergeReplay.load(path)
    return _loaded[path]


def encode(docs: DataFrame, doc_id: str, text: str, vocabulary: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> DataFrame:
    """Columns ``doc_id`` and ids: one list per row of ``docs``, repeated rows too.

    No special tokens: their spelling in a text is ordinary text.  Null and empty
    texts have the empty list.  The corpus is read once and never shuffled: the
    index covers a block of texts, and a word met before is looked up.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        for batch in batches:
            lists = own.encode(batch.column(1).to_pylist())
            ends, flat = [0], []
            for ids in lists:
                flat.append(np.array(ids, np.int32))
                ends.append(ends[-1] + len(ids))
            values = pa.array(np.concatenate(flat)) if flat else pa.array([], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)], names=[doc_id, "ids"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, text).mapInArrow(run, f"`{doc_id}` {kind}, ids array<int>")


def token_counts(docs: DataFrame, doc_id: str, text: str, tokenizers: Sequence[str], folder: str = TOKENIZERS) -> DataFrame:
    """Columns ``doc_id``, tokenizer, n_tokens of each non-empty text.

    ``tokenizers`` are names of files of ``folder`` without their suffix.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for name in tokenizers:
                counts = np.fromiter(_counter(folder, name)(texts), np.int64, len(texts))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([name] * len(texts), pa.string()), pa.array(counts)], names=[doc_id, "tokenizer", "n_tokens"])

    kind = docs.schema[doc_id].dataType.simpleString()
    some = docs.select(doc_id, text).where(f"length(`{text}`) > 0")
    return some.mapInArrow(run, f"`{doc_id}` {kind}, tokenizer string, n_tokens bigint")


_counters: dict[tuple[str, str], object] = {}


def _counter(folder: str, name: str):
    """How many tokens each of some texts has, by the file of this name; kept by the worker."""
    if (folder, name) in _counters:
        return _counters[folder, name]
    at = os.path.join(folder, name)
    if os.path.exists(f"{at}.tiktoken"):
        count = encoder(f"{at}.tiktoken").count
    elif os.path.exists(f"{at}.model"):
        count = PieceCounter(f"{at}.model").count
    elif os.path.exists(f"{at}.json"):
        import tokenizers

        model = tokenizers.Tokenizer.from_file(f"{at}.json")
        model.encode_special_tokens = True
        count = lambda texts: (len(x.ids) for b in blocks(texts) for x in model.encode_batch(b, add_special_tokens=False))
    else:
        raise ValueError(f"no vocabulary {name} in {folder}; every worker needs the folder at this path")
    _counters[folder, name] = count
    return count
