"""Packing token streams into sequences by order-preserving dynamic programming.

Documents are tokenised in the order of the input and laid end to end. Cuts may fall at the end of a document (free),
at the end of a sentence (SENTENCE) or, where neither is near, anywhere (INSIDE); a sequence holds at most ``size``
tokens. With c the tokens before a cut and p its penalty, the least cost up to cut j is

    f(j) = min over i with c_j - c_i <= size of (f(i) + c_i)  +  size - c_j + p_j

so the best predecessor is the minimum of f + c over a sliding window, held by a monotone queue: one pass, constant
work for each cut. What is left at the end of an input split is cut into powers of two, which need no padding.

Each Spark task packs its own split as a stream: nothing is shuffled, and a task holds one buffer of HELD tokens and
the longest document. Tokens are found word by word: the tokenizer's pre-tokenizer never joins across white space, so
a word's ids don't depend on its neighbours and a bounded cache of words spares most of the work.

Edge cases: null and empty texts are one token, the end mark; very long documents run over many sequences; repeated
rows are packed as documents of their own; an empty table gives no pieces; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm import textbytes as T
from causeway.llm.common import read, register

SIZE = 4096
END = 2
SENTENCE = 2.0
INSIDE = 24.0
HELD = 1 << 19
CACHED_WORDS = 300_000
SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "padded_to long")


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


class _Words(dict):
    """Packed ids by word; a word that isn't held is tokenised and kept. A full cache becomes the elder one, from which
    words that come again return."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer, self.model, self.elder = tokenizer, tokenizer.model, {}

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= CACHED_WORDS:
            self.elder = dict(self)
            self.clear()
        if (out := self.elder.get(word)) is None:
            # lower-case letters only: normalisation leaves them and they are one piece, spelled in byte characters
            if word.isalpha():
                ids = [t.id for t in self.model.tokenize(word.decode())]
            elif _PLAIN.fullmatch(text := word.decode("utf-8", "replace")):
                ids = [t.id for t in self.model.tokenize(word.decode("latin-1").translate(_BYTE_CHARACTERS))]
            else:
                ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            out = array("I", ids).tobytes()
        self[word] = out
        return out


#: Lower-case letters without a decomposed form: a-z and the small letters of Latin-1.
_PLAIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")
#: Byte-level BPE writes the bytes that Latin-1 doesn't print as the characters from 256 on, in order.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_CHARACTERS = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _SHOWN)}
_ALNUM = np.isin(np.arange(256), list(b"0123456789abcdefghijklmnopqrstuvwxyz"))
_PUNCTUATION = ~_ALNUM & (np.arange(256) > 32) & (np.arange(256) < 127)


class WordTokenizer:
    """Token ids of whole texts as packed little-endian unsigned 32-bit ids."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.words = _Words(self.tokenizer)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max([0, *vocabulary.values()]) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if re.fullmatch(r"[.!?]+(</w>)?", t)]] = True

    def _whole(self, text: bytes) -> bytes:
        return np.array(self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()

    def __call__(self, column: pa.Array) -> Iterator[bytes]:
        data, offsets = T.byte_runs(column)
        for at, end, raw, offs in T.chunks(data, offsets):
            # A-Z are lower-cased by the tokenizer too. Its pieces are runs of letters, digits and runs of other marks:
            # a blank between a letter and a mark changes nothing and spares the cache every word with its marks
            low = T._LOWER[raw]
            letter = _ALNUM[low]
            letter[1:] |= (low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] != 0x97) & (low[1:] != 0xB7)
            mark = _PUNCTUATION[low]
            mark[:1] = False
            mark[1:] &= letter[:-1]
            mark[offs[:-1][offs[:-1] < len(low)]] = False
            where = np.flatnonzero(mark)
            spaced = np.insert(low, where, 32).tobytes()
            new = offs + np.searchsorted(where, offs)
            special = raw.tobytes() if b"<|" in spaced else None
            for k in range(end - at):
                text = spaced[new[k]:new[k + 1]]
                if special is not None and b"<|" in text:  # the tokenizer's own marks are matched before lower-casing
                    yield self._whole(special[offs[k]:offs[k + 1]])
                else:
                    yield b"".join(map(self.words.__getitem__, text.split()))  # bytes split at the ASCII blanks only


def best_cuts(at: list[int], penalty: list[float], size: int) -> list[int]:
    """Indices of the cheapest cuts from position 0 to the last of ``at`` (ascending, gaps of at most ``size``)."""
    cost = [0.0] * (len(at) + 1)  # f + c of the start and of each cut
    back = [0] * (len(at) + 1)
    where = [0, *at]
    queue: deque[int] = deque([0])
    for j in range(1, len(where)):
        low = where[j] - size
        while where[queue[0]] < low:
            queue.popleft()
        i = queue[0]
        back[j] = i
        cost[j] = now = cost[i] + size + penalty[j - 1]  # f(j) + c_j
        while queue and cost[queue[-1]] >= now:
            queue.pop()
        queue.append(j)
    cuts, j = [], len(at)
    while j:
        cuts.append(j - 1)
        j = back[j]
    return cuts[::-1]


def candidate_cuts(ids: np.ndarray, doc_ends: np.ndarray, sentence_end: np.ndarray, size: int) -> tuple[list, list]:
    """Positions (ascending, the last is the end) and penalties."""
    kind = np.zeros(len(ids) + 1, np.int8)  # by position: 1 inside, 2 after a sentence, 3 after a document
    kind[1:] = 2 * sentence_end[np.minimum(ids, len(sentence_end) - 1)]
    kind[doc_ends] = 3
    at = np.flatnonzero(kind)
    gaps = np.diff(at, prepend=0)
    step = max(1, size // 64)
    if (wide := np.flatnonzero(gaps > step)).size:  # a long stretch without an end of a sentence
        for k in wide:
            kind[at[k] - gaps[k] + step:at[k]:step] = 1
        at = np.flatnonzero(kind)
    return at.tolist(), np.array([0.0, INSIDE, SENTENCE, 0.0])[kind[at]].tolist()


def powers_of_two(n: int, size: int) -> list[int]:
    out = [size] * (n // size)
    return out + [1 << b for b in range(size.bit_length() - 1, -1, -1) if (n % size) >> b & 1]


class Packer:
    """Packs one stream; ``add`` documents, then ``finish``; ``rows`` holds the pieces."""

    def __init__(self, first_sequence: int, sentence_end: np.ndarray, size: int = SIZE, held: int = HELD):
        self.size, self.held, self.sequence, self.sentence_end = size, held, first_sequence, sentence_end
        self.docs: deque = deque()  # [doc_id, packed ids, tokens, tokens already placed]
        self.tokens = 0
        self.rows: list[tuple] = []

    def add(self, doc_id, packed: bytes) -> None:
        n = len(packed) // 4
        self.docs.append([doc_id, packed, n, 0])
        self.tokens += n
        if self.tokens >= self.held:
            self._pack(last=False)

    def finish(self) -> None:
        if self.tokens:
            self._pack(last=True)

    def _pack(self, last: bool) -> None:
        parts = [p[4 * done:] for _, p, _, done in self.docs]
        ids = np.frombuffer(b"".join(parts), "<u4")
        ends = np.cumsum([len(p) // 4 for p in parts])
        at, penalty = candidate_cuts(ids, ends, self.sentence_end, self.size)
        cuts = [at[k] for k in best_cuts(at, penalty, self.size)]
        tail = cuts.pop()
        if last:
            lengths = np.diff([0, *cuts]).tolist()
            rest = tail - (cuts[-1] if cuts else 0)
            for n in lengths:
                self._emit(n, n if n & (n - 1) == 0 else self.size)
            for n in powers_of_two(rest, self.size) if rest < self.size * 0.9 else [rest]:
                self._emit(n, n if n & (n - 1) == 0 else self.size)
        else:  # the end of the buffer isn't the end of the stream: its last sequences wait for what follows
            for n in np.diff([0, *cuts[:-1]]).tolist():
                self._emit(n, n if n & (n - 1) == 0 else self.size)

    def _emit(self, n: int, padded: int) -> None:
        offset = 0
        while offset < n:
            doc = self.docs[0]
            take = min(n - offset, doc[2] - doc[3])
            piece = doc[1][4 * doc[3]:4 * (doc[3] + take)]
            self.rows.append((doc[0], doc[3], take, zlib.crc32(piece), doc[2], self.sequence, offset, padded))
            doc[3] += take
            offset += take
            if doc[3] == doc[2]:
                self.docs.popleft()
        self.sequence += 1
        self.tokens -= n


def pack(docs: DataFrame, tokenizer: str | None = None, size: int = SIZE, end: int = END, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """One row for each piece (SCHEMA): where it comes from, its checksum, its sequence and its place there.
    ``sequence_id`` is unique over the tasks; ``padded_to`` is the length of the sequence with padding."""
    path = tokenizer or default_tokenizer()
    end_mark = np.array([end], "<u4").tobytes()
    id_type = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = WordTokenizer(path), None
        names = [x.strip().split()[0] for x in SCHEMA.split(",")]

        def out() -> pa.RecordBatch:
            cols = [*zip(*packer.rows, strict=True)] or [()] * len(names)
            packer.rows = []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)

        for batch in batches:
            if packer is None:
                packer = Packer(TaskContext.get().partitionId() << 40, encode.ends, size)
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for doc_id, ids in zip(part.column(0).to_pylist(), encode(part.column(1)), strict=True):
                    packer.add(doc_id, ids + end_mark)
                if len(packer.rows) > 20_000:
                    yield out()
        if packer is not None:
            packer.finish()
            if packer.rows:
                yield out()

    if id_type not in ("bigint", "int", "smallint", "tinyint"):
        raise ValueError(f"{id_col} must be an integer, not {id_type}")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)


@register("op9_packing")
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens."""
    return pack(read(spark, sf_dir, "documents"))
