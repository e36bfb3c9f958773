r"""BPE encoding and decoding by forced boundaries.

A byte pair that no vocabulary token contains can never be merged, so a text may be cut there for certain: the
fragments are encoded one by one, each different fragment once per task, and their ids concatenated. The
pre-tokenizer splits on a pattern that looks ahead from white space and knows contractions; a cut is therefore made
only where it cannot see a difference: never after white space, before an apostrophe, inside a character, or inside
an added token. Before a space, the pair is never inside a token, so ordinary words are fragments.

Decoding looks up each id's bytes and joins them; bytes that are no UTF-8 become U+FFFD.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import others

#: Fragments that a task remembers; beyond it starts afresh.
REMEMBERED = 200_000
#: Characters that the pattern, in any reading, may take for white space; a cut is never made after one.
SPACES = re.compile("[\x00-\x20\x7f-\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u206f\u3000\ufeff]")


def byte_letters() -> dict[str, int]:
    """Byte-level BPE writes each byte as a printable character: itself, or one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ForcedBoundaryCoder:
    """The library's tokenizer, and what cutting texts for it takes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        self.added_pattern = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) or r"(?!)")
        self.bytes_of: dict[int, bytes] = {i: bytes(letters[c] for c in t) for t, i in spec["model"]["vocab"].items() if t not in self.added}
        inside = np.zeros(65536, bool)
        for token in self.bytes_of.values():
            for a, b in zip(token, token[1:], strict=False):
                inside[a << 8 | b] = True
        self.bytes_of |= {t["id"]: t["content"].encode() for t in spec.get("added_tokens", [])}
        first, second = np.arange(65536) >> 8, np.arange(65536) & 255
        ends_space = (first <= 0x20) | (first == 0x7F)
        self.cuts = ~inside & ~ends_space & (second != ord("'")) & ((second & 0xC0) != 0x80)
        self.known: dict[bytes, bytes] = {}  # ids of a fragment, packed

    def fragments(self, text: str) -> list[bytes]:
        data = text.encode("utf-8", "replace")
        if len(data) < 2:
            return [data] if data else []
        codes = np.frombuffer(data, np.uint8).astype(np.uint16)
        at = np.flatnonzero(self.cuts[codes[:-1] << 8 | codes[1:]]) + 1
        barred: set[int] = set()
        if not text.isascii():
            barred |= {len(text[: m.end()].encode("utf-8", "replace")) for m in SPACES.finditer(text) if ord(m[0]) > 0x7F}
        for m in self.added_pattern.finditer(text):
            start = len(text[: m.start()].encode("utf-8", "replace"))
            barred |= set(range(start + 1, start + len(m[0].encode())))
        ends = at.tolist() if not barred else [i for i in at.tolist() if i not in barred]
        return [data[a:b] for a, b in zip([0, *ends], [*ends, len(data)], strict=True)]

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the number of ids of each text."""
        cut = [self.fragments(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = list({f for fragments in cut for f in fragments if f not in self.known})
        for start in range(0, len(new), 2000):
            part = new[start : start + 2000]
            for f, e in zip(part, self.tokenizer.encode_batch([f.decode("utf-8") for f in part], add_special_tokens=False), strict=True):
                self.known[f] = np.array(e.ids, np.int32).tobytes()
        known = self.known
        rows = [b"".join([known[f] for f in fragments]) for fragments in cut]
        return np.frombuffer(b"".join(rows), np.int32), np.array([len(r) // 4 for r in rows], np.int64)

    def decode(self, ids: list[int]) -> str:
        return b"".join([self.bytes_of.get(i, b"") for i in ids]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def coder(path: str) -> ForcedBoundaryCoder:
    return ForcedBoundaryCoder(path)


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(values, pa.int32()))


def slices(part: pa.Array, rows: int = 128) -> Iterator[pa.Array]:
    """A batch in small parts, which bounds the Python objects that exist at a time."""
    return (part.slice(i, rows) for i in range(0, max(1, len(part)), rows))


def encoder(path: str):
    @F.arrow_udf("array<int>")
    def encode(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = coder(path)
        for part in texts:
            done = [own.encode_all([t or "" for t in few.to_pylist()]) for few in slices(part)]
            yield _lists(np.concatenate([v for v, _ in done]), np.concatenate([n for _, n in done]))

    return encode


def decoder(path: str):
    @F.arrow_udf("string")
    def decode(ids: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = coder(path)
        for part in ids:
            yield pa.array([own.decode(x or []) for few in slices(part) for x in few.to_pylist()], pa.string())

    return decode


def encode_texts(docs: DataFrame, tokenizer_path: str, text_col: str = "text") -> DataFrame:
    """docs with token_ids (array<int>) added: the ids that the tokenizers library gives the whole text, no special
    tokens added. Null and empty texts have no ids; repeated rows are encoded alike. A column named token_ids is
    replaced; an empty table gives an empty result."""
    return docs.select(*others(docs.columns, "token_ids"), encoder(tokenizer_path)(F.col(text_col)).alias("token_ids"))


def decode_ids(docs: DataFrame, tokenizer_path: str, ids_col: str = "token_ids") -> DataFrame:
    """docs with decoded_text added; null ids decode to the empty text. Repeated rows are decoded alike; a column named decoded_text is replaced; an
    empty table gives an empty result."""
    return docs.select(*others(docs.columns, "decoded_text"), decoder(tokenizer_path)(F.col(ids_col)).alias("decoded_text"))


def encode_and_decode(docs: DataFrame, tokenizer_path: str, text_col: str = "text") -> DataFrame:
    """encode_texts() and decode_ids() in one pass over the texts, which are dropped: token_ids and decoded_text."""
    kept = others(docs.columns, text_col, "token_ids", "decoded_text")
    fields = [f for f in docs.schema.fields if f.name in kept]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(tokenizer_path)
        for batch in batches:
            for start in range(0, batch.num_rows, 128):
                part = batch.slice(start, 128)
                ids = _lists(*own.encode_all([t or "" for t in part.column(len(names)).to_pylist()]))
                decoded = pa.array([own.decode(x.values.to_numpy().tolist()) for x in ids], pa.string())
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(names))), ids, decoded], names=[*names, "token_ids", "decoded_text"])
        own.known.clear()  # the worker lives on and runs other stages

    added = [T.StructField("token_ids", T.ArrayType(T.IntegerType())), T.StructField("decoded_text", T.StringType())]
    return docs.select(*names, F.col(text_col).alias("_text")).mapInArrow(run, T.StructType([*fields, *added]))


def sha256_of_ids(ids: Column) -> Column:
    return F.sha2(F.array_join(ids.cast("array<string>"), ","), 256)
