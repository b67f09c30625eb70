"""SentencePiece encoding that keeps byte offsets, and decoding.

The model's own normalisation is done here by longest prefix through its compiled character
map, and notes for each byte of the result which byte of the source it came from. The
pieces that the library finds tile the normalised text, so their ends, looked up in that
alignment, give each piece its span of the original bytes.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W

SPACE = "▁".encode()


class CharacterMap:
    """The compiled map of a model: a double-array trie from source bytes to replacements."""

    def __init__(self, blob: bytes) -> None:
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.texts = blob[4 + size :]

    def longest(self, source: bytes, at: int) -> tuple[int, bytes | None]:
        """Length of the longest prefix at a place that the map knows, and its replacement."""
        found: tuple[int, bytes | None] = (0, None)
        unit = self.units[0]
        node = _offset(unit)
        for i in range(at, len(source)):
            node ^= source[i]
            unit = self.units[node]
            if unit & (1 << 31 | 0xFF) != source[i]:
                break
            node ^= _offset(unit)
            if unit >> 8 & 1:
                value = self.units[node] & 0x7FFFFFFF
                found = i + 1 - at, self.texts[value : self.texts.index(b"\0", value)]
        return found


def _offset(unit: int) -> int:
    return unit >> 10 << ((unit & 1 << 9) >> 6)


class Codec:
    """A SentencePiece model with spans. Loaded once in each Python worker."""

    _loaded: dict[str, Codec] = {}

    def __init__(self, path: str) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        proto = sentencepiece_model_pb2.ModelProto.FromString(self.model.serialized_model_proto())
        self.rules = proto.normalizer_spec
        self.map = CharacterMap(self.rules.precompiled_charsmap)
        kind = sentencepiece_model_pb2.ModelProto.SentencePiece
        self.size = np.array([1 if p.type == kind.BYTE else 0 if p.type in (kind.CONTROL, kind.UNKNOWN) else len(p.piece.encode()) for p in proto.pieces])
        self.plain = not self.map.units and self.rules.escape_whitespaces and not self.rules.remove_extra_whitespaces
        self.names = [str(i) for i in range(len(proto.pieces))]

    @classmethod
    def load(cls, path: str) -> Codec:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def normalise(self, source: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised text, and for each of its bytes and its end the byte of the source."""
        if not source:
            return b"", np.zeros(1, np.int64)
        if self.plain:
            raw = np.frombuffer(source, np.uint8)
            n = np.where(raw == 0x20, 3, 1)
            begin = np.repeat(np.arange(len(raw)), n)
            out = source.replace(b" ", SPACE)
            if self.rules.add_dummy_prefix:
                return SPACE + out, np.concatenate([[0, 0, 0], begin, [len(raw)]])
            return out, np.append(begin, len(raw))
        space = SPACE if self.rules.escape_whitespaces else b" "
        parts: list[tuple[bytes, int]] = []
        at = 0
        while at < len(source):
            n, text = self.map.longest(source, at) if self.map.units else (0, None)
            if text is None:
                n = next((k for k in range(1, 4) if at + k >= len(source) or source[at + k] & 0xC0 != 0x80), 4)
                text = source[at : at + n]
            parts.append((text, at))
            at += n
        end, front = len(source), 0
        if self.rules.remove_extra_whitespaces:
            # the blank in front stands where the text begins, after blanks that go
            front = next((at for text, at in parts if text != b" "), 0)
            parts = [(text[i : i + 1], at) for text, at in parts for i in range(len(text))]
            while parts and parts[-1][0] == b" ":
                end = parts.pop()[1]
            keep = [p for i, p in enumerate(parts) if p[0] != b" " or i and parts[i - 1][0] != b" "]
            parts = keep
        out = [(space, front)] if self.rules.add_dummy_prefix and parts else []
        out += [(text.replace(b" ", space), at) for text, at in parts]
        return b"".join(t for t, _ in out), np.append(np.repeat([a for _, a in out], [len(t) for t, _ in out]), end).astype(np.int64)

    def spans(self, source: bytes, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
        """Begin and end of each piece in the source bytes, and whether the pieces tile the normalised text."""
        text, align = self.normalise(source)
        size = self.size[ids]
        unknown = np.flatnonzero(size == 0)
        if len(unknown) == 1:
            size = size.copy()
            size[unknown] = len(text) - size.sum()
        stop = np.cumsum(size)
        if not len(ids):
            return stop, stop, not len(text)
        if stop[-1] != len(text):
            got = self.model.encode(source.decode(), out_type="immutable_proto").pieces
            raw = source.decode()
            to = np.cumsum([0, *(len(c.encode()) for c in raw)])
            return np.array([to[p.begin] for p in got]), np.array([to[p.end] for p in got]), False
        end = align[stop]
        # a piece that ends inside a longer source character still covers all of it
        return align[stop - size], np.maximum(end, align[stop - size]), True


def _encoded(path: str, arrays: tuple[str, ...]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.load(path)
        for batch in W.steps(batches):
            texts = [x or "" for x in batch.column("text").to_pylist()]
            ids = codec.model.encode(texts, out_type=int, num_threads=1)
            decoded = codec.model.decode(ids)
            names = codec.names
            rows: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "n_bytes": [], "tiled": []}
            more: dict[str, list] = {"ids": [], "begins": [], "ends": [], "decoded": []}
            for text, own, back in zip(texts, ids, decoded, strict=True):
                source = text.encode()
                begin, end, tiled = codec.spans(source, np.array(own, np.int64))
                rows["n_tokens"].append(len(own))
                rows["ids_sha256"].append(hashlib.sha256(",".join([names[i] for i in own]).encode()).hexdigest())
                rows["decoded_sha256"].append(hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest())
                rows["n_bytes"].append(int(end[-1]) if len(end) else 0)
                rows["tiled"].append(bool(tiled))
                for k, x in zip(more, (own, begin, end, back), strict=True):
                    if k in arrays:
                        more[k].append(x)
            kinds = {"n_tokens": pa.int64(), "n_bytes": pa.int64(), "tiled": pa.bool_(), "ids": pa.list_(pa.int32()), "begins": pa.list_(pa.int64()), "ends": pa.list_(pa.int64())}
            out = rows | {k: more[k] for k in arrays}
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, kinds.get(k, pa.string())) for k, x in out.items())], ["doc_id", *out])

    return run


ARRAYS = {"ids": "array<int>", "begins": "array<long>", "ends": "array<long>", "decoded": "string"}


def encode(docs: DataFrame, path: str, arrays: tuple[str, ...] = tuple(ARRAYS), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text as the sentencepiece library does, and decode the ids again.

    Args:
        path: the model file, at the same place on every executor.
        arrays: which of ids, begins and ends (spans in the bytes of the text) and decoded
            (the text) to return; without them only counts and digests leave the executors.

    Returns doc_id, n_tokens, ids_sha256, decoded_sha256, n_bytes (where the last span ends)
    and tiled (whether the pieces tile the normalised text), then the arrays: a row for each
    row. A null text is an empty one and has no pieces.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = "n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long, tiled boolean" + "".join(f", {k} {ARRAYS[k]}" for k in arrays)
    return docs.mapInArrow(_encoded(path, arrays), T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL(kind).fields]))
