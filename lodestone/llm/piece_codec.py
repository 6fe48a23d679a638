"""SentencePiece encoding and decoding that keeps the source bytes of every piece.

Ids come from the sentencepiece library. The normaliser is read from the model: at each place the longest entry of the
compiled character map (a double-array trie) is replaced, else one character is copied, and for every byte of the
normalised text the source byte is recorded. The pieces tile the normalised text, so their lengths project each of
them to a span of the original bytes. Copied characters align byte by byte; all bytes of a replacement align to the
begin of what it replaces.

A model whose character map is empty copies every character, so its alignment is made for whole texts at once. Only a
model without byte pieces knows unknown characters; texts that hold some are encoded a second time, for their lengths.

Defined results: a null text is an empty one and has no pieces; repeated rows get equal results; empty tables give
empty tables; texts of any length are encoded whole; bytes that are no UTF-8 count as U+FFFD, and spans then refer to the
mended text; other columns are not read, and the kept ones may have any name but those of the results and __text.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import pieces, small_batches

SPACE = "▁".encode()


class CharacterMap:
    """The compiled map of a model: replacements by longest prefix. Format: size of the trie in bytes (4 bytes, little endian), its units (4 bytes each), then the replacements, each ended by a zero byte."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if size else []
        self.texts = blob[4 + size :] if size else b""

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest entry that begins at a place, and its replacement."""
        units = self.units
        if not units:
            return None
        jump = lambda u: (u >> 10) << ((u & 0x200) >> 6)
        node, found = jump(units[0]), None
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= jump(unit)
            if unit & 0x100:
                found = (i + 1 - at, units[node] & 0x7FFFFFFF)
        if found is None:
            return None
        return found[0], self.texts[found[1] : self.texts.index(b"\0", found[1])]


class Codec:
    def __init__(self, model_file: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(model_file, "rb") as f:
            blob = f.read()
        proto.ParseFromString(blob)
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=blob)
        spec = proto.normalizer_spec
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.prefix, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.suffix = proto.trainer_spec.treat_whitespace_as_suffix
        self.mark = SPACE if self.escape else b" "
        self.unknown = self.sp.unk_id()
        #: bytes of normalised text that a piece stands for; a byte piece for one
        self.lengths = np.array([1 if p.type == p.BYTE else len(p.piece.encode()) for p in proto.pieces], np.int64)

    def normalise(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised text, and for each of its bytes and its end the source byte."""
        if not self.map.units and not self.squeeze and not self.suffix:
            return self._copied(data)
        out, align, i, n = bytearray(), [], 0, len(data)
        chunks: list[tuple[bytes, list[int]]] = []
        while i < n:
            if hit := self.map.longest(data, i):
                chunks.append((hit[1], [i] * len(hit[1])))
                i += hit[0]
            else:
                k = 1
                while i + k < n and data[i + k] & 0xC0 == 0x80:
                    k += 1
                chunks.append((data[i : i + k], list(range(i, i + k))))
                i += k
        flat = b"".join(c for c, _ in chunks)
        places = [p for _, ps in chunks for p in ps]
        end = n
        if self.squeeze:
            keep = [k for k in range(len(flat)) if flat[k] != 32 or (k > 0 and flat[k - 1] != 32)]
            while keep and flat[keep[-1]] == 32:
                end = places[keep.pop()]
            flat, places = bytes(flat[k] for k in keep), [places[k] for k in keep]
        if not flat:
            return b"", np.array([end], np.int64)
        if self.prefix and not self.suffix:
            out += self.mark
            align += [places[0]] * len(self.mark)
        for b, p in zip(flat, places, strict=True):
            out += self.mark if b == 32 else bytes([b])
            align += [p] * (len(self.mark) if b == 32 else 1)
        if self.prefix and self.suffix:
            out += self.mark
            align += [end] * len(self.mark)
        return bytes(out), np.array([*align, end], np.int64)

    def _copied(self, data: bytes) -> tuple[bytes, np.ndarray]:
        if not data:
            return b"", np.zeros(1, np.int64)
        out = data.replace(b" ", self.mark) if self.escape else data
        times = np.where(np.frombuffer(data, np.uint8) == 32, len(self.mark), 1)
        align = np.append(np.repeat(np.arange(len(data)), times), len(data))
        if self.prefix:
            out, align = self.mark + out, np.concatenate([np.zeros(len(self.mark), np.int64), align])
        return out, align

    def encode(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each text its ids, and begins and ends of their spans in its bytes."""
        whole = [t.decode("utf-8", "replace") for t in texts]
        out = []
        for text, data, ids in zip(whole, texts, self.sp.encode(whole, return_type="numpy", num_threads=1), strict=True):
            normal, align = self.normalise(text.encode() if "\ufffd" in text else data)
            sizes = self.lengths[ids]
            if (ids == self.unknown).any():
                sizes = np.array([len(p.encode()) if i == self.unknown else s for p, i, s in zip(self.sp.encode(text, return_type=str), ids, sizes, strict=True)], np.int64)
            ends = np.cumsum(sizes)
            if len(ids) and ends[-1] != len(normal):
                raise ValueError("the pieces do not tile the normalised text")
            out.append((ids, align[ends - sizes], align[ends]))
        return out

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        return [self.sp.decode(i.tolist()) for i in ids]


@lru_cache(maxsize=2)
def codec(model_file: str) -> Codec:
    return Codec(model_file)


def _texts(df: DataFrame, text: str, keep: tuple[str, ...]) -> DataFrame:
    return df.select(*[F.col(c) for c in keep], F.col(text).cast("string").alias("__text"))


def _run(base: DataFrame, keep: tuple[str, ...], schema: str, make) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "__text", 4 << 20):
                raw = [x or b"" for x in part.column("__text").cast(pa.binary()).to_pylist()]
                made = make(raw)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], *made.values()], names=[*keep, *made])

    fields = "".join(f"`{c}` {t}, " for c, t in base.dtypes if c != "__text")
    return small_batches(base).mapInArrow(run, fields + schema)


def _lists(arrays: list[np.ndarray], kind) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    values = np.concatenate(arrays) if arrays else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def encode(df: DataFrame, model_file: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, ids, and begins and ends of the pieces' spans in the UTF-8 bytes of the text."""

    def make(raw: list[bytes]) -> dict:
        found = codec(model_file).encode(raw)
        return {"ids": _lists([f[0] for f in found], pa.int32()), "begins": _lists([f[1] for f in found], pa.int64()), "ends": _lists([f[2] for f in found], pa.int64())}

    return _run(_texts(df, text, keep), keep, "ids array<int>, begins array<bigint>, ends array<bigint>", make)


def decode(df: DataFrame, model_file: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the decoded text in column out (which replaces one of that name); null ids give null."""
    kept = [c for c in df.columns if c != out]
    base = df.select(*[F.col(f"`{c}`") for c in kept])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = codec(model_file).sp
        for batch in batches:
            texts = [None if x is None else sp.decode([i for i in x if i is not None]) for x in batch.column(kept.index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*kept, out])

    fields = ", ".join(f"`{c}` {t}" for c, t in base.dtypes)
    return small_batches(base).mapInArrow(run, f"{fields}, `{out}` string")


def round_trip(df: DataFrame, model_file: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), with_ids: bool = False) -> DataFrame:
    """The kept columns and digests of what encode and decode give: n_tokens, ids_sha256, decoded_sha256, n_spanned (bytes of the text that spans cover), spans_sha256 (of all begins, then all ends, 8 bytes each, little endian); with_ids: the ids as well."""

    def make(raw: list[bytes]) -> dict:
        c = codec(model_file)
        found = c.encode(raw)
        ids = [f[0] for f in found]
        return {
            "n_tokens": pa.array([len(i) for i in ids], pa.int64()),
            "ids_sha256": pa.array([hashlib.sha256(",".join(map(str, i.tolist())).encode()).hexdigest() for i in ids], pa.string()),
            "decoded_sha256": pa.array([hashlib.sha256(t.encode("utf-8", "replace")).hexdigest() for t in c.decode(ids)], pa.string()),
            "n_spanned": pa.array([int((e - b).sum()) for _, b, e in found], pa.int64()),
            "spans_sha256": pa.array([hashlib.sha256(np.concatenate([b, e]).astype("<i8").tobytes()).hexdigest() for _, b, e in found], pa.string()),
        } | ({"ids": _lists(ids, pa.int32())} if with_ids else {})

    return _run(_texts(df, text, keep), keep, "n_tokens bigint, ids_sha256 string, decoded_sha256 string, n_spanned bigint, spans_sha256 string" + ", ids array<int>" * with_ids, make)
