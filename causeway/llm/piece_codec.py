"""SentencePiece BPE: encoding with byte spans of the original text, and decoding.

Encoding, step by step as the model file prescribes:

1. Normalisation. At every place the longest key of the model's compiled character map (a double-array trie) is
   replaced by its value, any other character is copied, and the blank is written as the mark U+2581. Every byte of the
   normalised text records where in the original it comes from: a copied byte its own place, a replacement the start of
   what it replaces.
2. Segments. Where no piece of the vocabulary holds two characters side by side, no merge ever joins them: the text is
   cut there. A segment's pieces don't depend on its neighbours, so a bounded cache of short segments, kept by the Python
   worker over its tasks, spares most of the work.
3. Merges. In a segment the adjacent pair that spells the best-scored piece is merged, leftmost first among equals,
   until none is left; long segments take the pairs from a heap. What isn't in the vocabulary becomes one piece for each of its bytes.
4. Spans. Pieces lie end to end in the normalised text; the recorded places turn their borders into byte spans of the
   original. Spans are in order and don't overlap; a piece of nothing but the added mark has an empty span.

Decoding looks every id up: pieces with marks as blanks, bytes as bytes (U+FFFD for each one that is no UTF-8), control
ids as nothing; the mark added at the start is taken off.

Each Spark task works on its own rows in slices of a few hundred; nothing is shuffled and no text is cut.

Edge cases: null and empty texts have only the end id and decode to the empty text; very long texts and words are encoded
whole; repeated rows are rows of their own; an empty table gives no rows; a column of the input whose name the result
needs is an error, other columns are kept where they are named in ``keep``. Decoding null ids gives null.
"""

from __future__ import annotations

import codecs
import heapq
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm import textbytes as T
from causeway.llm.common import read, register

MARK = "▁"
CACHED_SEGMENTS = 250_000
LONGEST_CACHED = 48
#: Characters that are told apart where segments are cut: up to the end of Latin Extended-B; then the mark; all others.
_LETTERS = 0x250
_INF = float("inf")
SLICE = 128

codecs.register_error("piece_codec", lambda e: ("�" * (e.end - e.start), e.end))


def default_model() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


class CharacterMap:
    """The compiled map: a count of bytes, that many bytes of a double array of 32-bit units, then the values, each
    ended by a zero byte. A unit holds a label (its low byte), an offset (from bit 10, scaled by 256 if bit 9 is set) and
    whether a key ends there (bit 8); the unit at the offset then holds the place of the value."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4:4 + size], "<u4").tolist()
        self.values = blob[4 + size:]

    def starts(self) -> set[int]:
        """Bytes that a key begins with."""
        return {b for b in range(256) if self.units and self._step(self._offset(self.units[0]), b) is not None}

    @staticmethod
    def _offset(unit: int) -> int:
        return unit >> 10 << (8 if unit >> 9 & 1 else 0)

    def _step(self, node: int, byte: int) -> int | None:
        node ^= byte
        return node if node < len(self.units) and self.units[node] & 0x800000FF == byte else None

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """(bytes read, their replacement) of the longest key at ``at``."""
        found, node, k = None, self._offset(self.units[0]), at
        while k < len(data) and (node := self._step(node, data[k])) is not None:
            k += 1
            unit = self.units[node]
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                found = (k - at, self.units[node] & 0x7FFFFFFF)
        if found is None:
            return None
        return found[0], self.values[found[1]:self.values.index(0, found[1])]


class Normalizer:
    """Normalised text and, for each of its bytes and its end, the byte of the original it comes from."""

    def __init__(self, spec):
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.prefix, self.squeeze = spec.add_dummy_prefix, spec.remove_extra_whitespaces
        if not spec.escape_whitespaces:
            raise ValueError("the model doesn't write blanks as marks")
        self.starts = self.map.starts()
        self.special = re.compile(b"[" + b"".join(re.escape(bytes([b])) for b in sorted(self.starts | {32})) + b"]")

    def __call__(self, raw: bytes) -> tuple[str, np.ndarray]:
        if not raw:
            return "", np.zeros(1, np.int64)
        if self.starts or self.squeeze:
            return self._mapped(raw)
        text = raw.decode().replace(" ", MARK)
        wide = np.repeat(np.arange(len(raw) + 1), np.append(1 + 2 * (np.frombuffer(raw, np.uint8) == 32), 1))
        if not self.prefix:
            return text, wide
        return MARK + text, np.concatenate([np.zeros(3, np.int64), wide])

    def _mapped(self, raw: bytes) -> tuple[str, np.ndarray]:
        parts: list[bytes] = []  # copied stretches and replacements
        places: list[np.ndarray] = []
        at = 0
        while at < len(raw):
            hit = self.special.search(raw, at)
            # a key may begin inside a character only where the character begins
            stop = hit.start() if hit else len(raw)
            if stop > at:
                parts.append(raw[at:stop])
                places.append(np.arange(at, stop))
                at = stop
                continue
            found = self.map.longest(raw, at) if raw[at] in self.starts else None
            if found is None:
                width = 1
                while at + width < len(raw) and raw[at + width] & 0xC0 == 0x80:
                    width += 1
                parts.append(raw[at:at + width])
                places.append(np.arange(at, at + width))
                at += width
            else:
                parts.append(found[1])
                places.append(np.full(len(found[1]), at))
                at += found[0]
        data = np.frombuffer(b"".join(parts), np.uint8)
        place = np.append(np.concatenate([np.zeros(0, np.int64), *places]), len(raw))
        blank = data == 32
        if self.squeeze:  # blanks at the start and after a blank go
            if blank.all():
                return "", np.array([len(raw)])
            keep = ~blank
            keep[1:] |= ~blank[:-1]
            place = np.append(place[:-1][keep], place[-1])
            data = data[keep]
            blank = data == 32
        place = np.repeat(place, np.append(1 + 2 * blank, 1))
        text = data.tobytes().decode().replace(" ", MARK)
        if self.prefix:
            text, place = MARK + text, np.concatenate([np.full(3, place[0]), place])
        if self.squeeze:  # marks at the end go, wherever they come from
            text = text.rstrip(MARK)
            place = place[:len(text.encode()) + 1]
        return text, place


class Segments(dict):
    """Packed ids by segment; a full cache of short segments becomes the elder one, from which segments come back."""

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec, self.elder = codec, {}

    def __missing__(self, segment: str) -> bytes:
        if len(segment) > LONGEST_CACHED:
            return self.codec.merge(segment)
        if len(self) >= CACHED_SEGMENTS:
            self.elder = dict(self)
            self.clear()
        if (out := self.elder.get(segment)) is None:
            out = self.codec.merge(segment)
        self[segment] = out
        return out


class Codec:
    """Encoder and decoder of one model file."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb
        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        kind = pb.ModelProto.SentencePiece
        trainer = model.trainer_spec
        if trainer.model_type != pb.TrainerSpec.BPE or not trainer.byte_fallback or trainer.treat_whitespace_as_suffix:
            raise ValueError("only BPE models with byte pieces and blanks before words are supported")
        if any(p.type in (kind.USER_DEFINED, kind.UNUSED) for p in model.pieces):
            raise ValueError("models with pieces of the user's own or unused pieces aren't supported")
        if model.denormalizer_spec.precompiled_charsmap:
            raise ValueError("models that change decoded texts aren't supported")
        self.normalize = Normalizer(model.normalizer_spec)
        self.drop_prefix = model.normalizer_spec.add_dummy_prefix or model.normalizer_spec.remove_extra_whitespaces
        self.pieces = {p.piece: (-p.score, i) for i, p in enumerate(model.pieces) if p.type == kind.NORMAL}
        self.byte_ids = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == kind.BYTE}
        self.end = next(i for i, p in enumerate(model.pieces) if p.type == kind.CONTROL and p.piece == trainer.eos_piece)
        self.spelled, self.marked = [], []
        lengths = np.zeros(len(model.pieces), np.int64)
        for i, p in enumerate(model.pieces):
            self.marked.append(p.type == kind.NORMAL and p.piece.startswith(MARK))
            if p.type == kind.NORMAL:
                self.spelled.append(p.piece.replace(MARK, " ").encode())
                lengths[i] = len(p.piece.encode())
            elif p.type == kind.BYTE:
                self.spelled.append(bytes([int(p.piece[3:5], 16)]))
                lengths[i] = 1
            else:
                self.spelled.append(trainer.unk_surface.encode() if p.type == kind.UNKNOWN else b"")
        self.control = [p.type == kind.CONTROL for p in model.pieces]
        self.lengths = lengths
        self.kind = np.full(0x110000, _LETTERS + 1, np.uint16)
        self.kind[:_LETTERS] = np.arange(_LETTERS)
        self.kind[ord(MARK)] = _LETTERS
        self.side_by_side = np.zeros((_LETTERS + 2, _LETTERS + 2), bool)
        for p in self.pieces:
            kinds = self.kind[[ord(c) for c in p]]
            self.side_by_side[kinds[:-1], kinds[1:]] = True
        self.rank = {p: score for p, (score, _) in self.pieces.items()}
        self.number = {p: i for p, (_, i) in self.pieces.items()}
        self.segments = Segments(self)

    def split(self, text: str) -> list[str]:
        """The segments of a normalised text."""
        kinds = self.kind[np.frombuffer(text.encode("utf-32-le"), "<u4")]
        cuts = [0, *(np.flatnonzero(~self.side_by_side[kinds[:-1], kinds[1:]]) + 1).tolist(), len(text)]
        return [text[a:b] for a, b in zip(cuts, cuts[1:])] if text else []

    def merge(self, segment: str) -> bytes:
        """Packed 32-bit ids of one segment."""
        part = self._merge_long(segment) if len(segment) > LONGEST_CACHED else self._merge_short(segment)
        try:
            return array("i", map(self.number.__getitem__, part)).tobytes()
        except KeyError:  # a character that isn't in the vocabulary
            known = self.number
            return array("i", [i for p in part for i in ((known[p],) if p in known else map(self.byte_ids.get, p.encode()))]).tobytes()

    def _merge_short(self, segment: str) -> list[str]:
        part, get = list(segment), self.rank.get
        ranks = [get(a + b, _INF) for a, b in zip(part, part[1:])]
        while ranks and (best := min(ranks)) != _INF:
            i = ranks.index(best)
            part[i:i + 2] = [part[i] + part[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = get(part[i - 1] + part[i], _INF)
            if i < len(ranks):
                ranks[i] = get(part[i] + part[i + 1], _INF)
        return part

    def _merge_long(self, segment: str) -> list[str]:
        part = list(segment)
        n = len(part)
        following, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pieces, heap = self.pieces, []
        for i in range(n - 1):
            if (best := pieces.get(part[i] + part[i + 1])) is not None:
                heap.append((best[0], i, part[i] + part[i + 1]))
        heapq.heapify(heap)
        while heap:
            _, i, joined = heapq.heappop(heap)
            j = following[i] if part[i] else n
            if j >= n or part[i] + part[j] != joined:
                continue  # one of the two has been merged meanwhile
            part[i], part[j] = joined, ""
            following[i] = k = following[j]
            if k < n:
                before[k] = i
                if (best := pieces.get(joined + part[k])) is not None:
                    heapq.heappush(heap, (best[0], i, joined + part[k]))
            if (h := before[i]) >= 0 and (best := pieces.get(part[h] + joined)) is not None:
                heapq.heappush(heap, (best[0], h, part[h] + joined))
        return [p for p in part if p]

    def encode(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a text (UTF-8) and the borders of their spans, one more than ids."""
        text, place = self.normalize(raw)
        ids = np.frombuffer(b"".join(map(self.segments.__getitem__, self.split(text))), np.int32)
        borders = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(self.lengths[ids], out=borders[1:])
        return ids, place[borders]

    def decode(self, ids: list[int]) -> str:
        data = b"".join(map(self.spelled.__getitem__, ids))
        if self.drop_prefix and (first := next((i for i in ids if not self.control[i]), None)) is not None and self.marked[first]:
            data = data[1:]
        return data.decode("utf-8", "piece_codec")


@lru_cache(maxsize=1)
def _codec(path: str) -> Codec:
    """A Python worker keeps its codec, and the segments it knows, over its tasks."""
    return Codec(path)


def encode(docs: DataFrame, model: str | None = None, end: bool = True, decoded: bool = False, keep: tuple[str, ...] = ("doc_id",),
           text_col: str = "text") -> DataFrame:
    """The columns ``keep``, ``ids`` (with the end id behind them if ``end``) and ``begins`` and ``ends``, the byte spans of
    all ids in the text (the end id's is empty, at its end); with ``decoded`` also the text that the ids decode to."""
    path = model or default_model()
    names = [*keep, "ids", "begins", "ends", *(["decoded"] if decoded else [])]
    if len(set(names)) < len(names):
        raise ValueError("ids, begins, ends and decoded are names of the result")
    types = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keep), "ids array<int>", "begins array<int>", "ends array<int>",
                        *(["decoded string"] if decoded else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path)
        last = np.array([codec.end] if end else [], np.int32)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                data, offsets = T.byte_runs(part.column(0))
                data = data.tobytes()
                ids, begins, ends, texts = [], [], [], []
                for k in range(part.num_rows):
                    raw = data[offsets[k]:offsets[k + 1]]
                    own, borders = codec.encode(raw)
                    ids.append(np.concatenate([own, last]))
                    begins.append(np.concatenate([borders[:-1], np.full(len(last), len(raw))]).astype(np.int32))
                    ends.append(np.concatenate([borders[1:], np.full(len(last), len(raw))]).astype(np.int32))
                    if decoded:
                        texts.append(codec.decode(ids[-1].tolist()))
                starts = pa.array(np.cumsum([0, *map(len, ids)]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(starts, pa.array(np.concatenate(x))) for x in (ids, begins, ends)]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[1:], *lists, *([pa.array(texts, pa.string())] if decoded else [])], names=names)

    return docs.select(F.col(text_col).alias("_text"), *(F.col(c) for c in keep)).mapInArrow(run, schema)


def decode(df: DataFrame, model: str | None = None, keep: tuple[str, ...] = ("doc_id",), ids_col: str = "ids") -> DataFrame:
    """The columns ``keep`` and ``decoded``, the text of ``ids_col``."""
    path = model or default_model()
    if "decoded" in keep:
        raise ValueError("decoded is a name of the result")
    types = dict(df.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keep), "decoded string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                texts = [None if x is None else codec.decode(x) for x in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(texts, pa.string())], names=[*keep, "decoded"])

    return df.select(F.col(ids_col).alias("_ids"), *(F.col(c) for c in keep)).mapInArrow(run, schema)


@register("op12_piece_codec")
def op12_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded with an end id and decoded again; digests of both."""
    coded = encode(read(spark, sf_dir, "documents"), decoded=True)
    written = F.array_join(F.transform("ids", lambda i: i.cast("string")), " ")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(written, 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))
