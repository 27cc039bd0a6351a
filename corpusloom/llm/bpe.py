"""BPE encoding and decoding by forced-boundary splitting.

A byte pair that occurs inside no vocabulary token can never be joined by a
merge, so a text may be cut there and the fragments encoded independently;
each distinct fragment of a batch is encoded once.

Where a cut could change how the byte-level pre-tokenizer divides the text, none
is made: not inside a character, not after white space, not before an apostrophe
(the contractions), and not after a three-byte character whose block holds
Unicode spaces. What remains are cuts for which the ids are those of the whole
text.

Nulls and empty texts give no ids; very long texts are one row's work; repeated
rows are encoded like any other; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _arrow

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
os.environ.setdefault("RAYON_NUM_THREADS", "1")

#: Fragments whose ids a worker keeps, some 150 bytes each; beyond it the memory starts anew.
REMEMBERED = 600_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = set(range(0x21, 0x7F)) | set(range(0xA1, 0xAD)) | set(range(0xAE, 0x100))
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class ForcedBoundaryBPE:
    """Encoder and decoder for one byte-level BPE tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        if spec["model"]["type"] != "BPE" or pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) or pre.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError(f"{path}: forced boundaries are proven for plain byte-level BPE only")
        byte_of = {c: b for b, c in enumerate(byte_symbols())}
        size = max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.piece: list[bytes] = [b""] * size
        for token, i in spec["model"]["vocab"].items():
            self.piece[i] = bytes(byte_of[c] for c in token)
        for token in spec["added_tokens"]:
            self.piece[token["id"]] = token["content"].encode()
        inside = np.zeros((256, 256), bool)
        for token in self.piece:
            b = np.frombuffer(token, np.uint8)
            inside[b[:-1], b[1:]] = True
        kind = (~inside).astype(np.uint8)  # 1: a cut; 2: a cut if the character before is no space
        kind[:0x21] = 0
        kind[0x7F] = 0
        kind[:, 0x27] = 0
        kind[0x80:] *= 2
        kind[0xC0:] = 0
        kind[:, 0x80:0xC0] = 0
        self.kind = kind.reshape(-1)
        self.forget()

    def cuts(self, buf: np.ndarray) -> np.ndarray:
        """Positions at which the bytes can be split without changing the ids."""
        if len(buf) < 2:
            return np.zeros(0, np.int64)
        pair = buf[:-1].astype(np.uint16)
        pair <<= 8
        pair |= buf[1:]
        kind = self.kind[pair]
        at = np.flatnonzero(kind)
        soft = kind[at] == 2
        if soft.any():
            i = at[soft]
            b1 = buf[np.maximum(i - 1, 0)]
            b2 = buf[np.maximum(i - 2, 0)]
            b3 = buf[np.maximum(i - 3, 0)]
            ok = (b1 >= 0xC3) & (b1 <= 0xDF)
            ok |= (b1 < 0xC0) & (b1 >= 0x80) & (((b2 >= 0xE4) & (b2 <= 0xEF)) | ((b2 < 0xC0) & (b2 >= 0x80) & (b3 >= 0xF0)))
            keep = np.ones(len(at), bool)
            keep[np.flatnonzero(soft)[~ok]] = False
            at = at[keep]
        return at + 1

    def forget(self) -> None:
        self.slot: dict[str, int] = {}
        self.size = self.begin = np.zeros(0, np.int64)
        self.known = np.zeros(0, np.uint32)

    def slots(self, fragments: list[str]) -> np.ndarray:
        """Where the ids of each fragment are kept; fragments met before are not encoded again."""
        if len(self.slot) > REMEMBERED:
            self.forget()
        fresh = [x for x in fragments if x not in self.slot]
        if fresh:
            found = [e.ids for e in self.tok.encode_batch_fast(fresh, add_special_tokens=False)]
            self.slot.update(zip(fresh, range(len(self.slot), len(self.slot) + len(fresh)), strict=True))
            size = np.fromiter(map(len, found), np.int64, len(found))
            self.begin = np.concatenate([self.begin, len(self.known) + np.cumsum(size) - size])
            self.size = np.concatenate([self.size, size])
            self.known = np.concatenate([self.known, np.fromiter(chain.from_iterable(found), np.uint32, int(size.sum()))])
        return np.fromiter(map(self.slot.__getitem__, fragments), np.int64, len(fragments))

    def encode_flat(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and the offsets of each text's ids."""
        mark = np.zeros(len(buf) + 1, bool)
        mark[self.cuts(buf)] = True
        mark[off] = True
        mark[0] = mark[-1] = True
        bound = np.flatnonzero(mark)
        if len(bound) < 2:
            return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
        parts = pa.Array.from_buffers(pa.large_string(), len(bound) - 1, [None, pa.py_buffer(bound.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(buf))])
        coded = parts.dictionary_encode()
        which = self.slots(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        length = self.size[which]
        upto = np.concatenate([[0], np.cumsum(length)])
        ids = self.known[np.repeat(self.begin[which] - upto[:-1], length) + np.arange(upto[-1])]
        return ids, upto[np.searchsorted(bound, off)]

    def encode(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, end row, ids, offsets) for bounded runs of a batch's rows."""
        for first, end, buf, off in _arrow.chunks(column, 4 << 20):
            yield first, end, *self.encode_flat(buf, off)

    def decode(self, ids: list[int]) -> str:
        """The text of ``ids``, special tokens included; broken UTF-8 becomes U+FFFD."""
        return b"".join(map(self.piece.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> ForcedBoundaryBPE:
    return ForcedBoundaryBPE(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids array<int>): the ids of every text."""

    def run(batches):
        bpe = codec(path)
        for batch in batches:
            for first, end, ids, off in bpe.encode(batch.column(1)):
                lists = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), lists], ["id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(_arrow.tidy(run), f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(tokens: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, text): the text of every id list; null ids give null."""

    def run(batches):
        bpe = codec(path)
        for batch in batches:
            text = [None if x is None else bpe.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string())], ["id", "text"])

    kind = tokens.schema[id_col].dataType.simpleString()
    return tokens.select(id_col, ids_col).mapInArrow(_arrow.tidy(run), f"id {kind}, text string").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row; no shuffle.

    The ids never leave the worker: they are as many bytes as the texts, and the
    digests are all that is asked for.
    """

    def run(batches):
        bpe = codec(path)
        name = list(map(str, range(len(bpe.piece))))
        for batch in batches:
            for first, end, ids, off in bpe.encode(batch.column(1)):
                count, a, b = np.diff(off), [], []
                for i in range(end - first):
                    own = ids[off[i] : off[i + 1]].tolist()
                    a.append(hashlib.sha256(",".join(map(name.__getitem__, own)).encode()).hexdigest())
                    b.append(hashlib.sha256(bpe.decode(own).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array(count, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(_arrow.tidy(run), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
