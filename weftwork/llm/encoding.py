"""Encoding of a corpus with a public tokenizer, with offsets, and decoding.

Arrow batches go to the tokenizers library as they are; texts are handed over in groups of bounded size, so that memory
follows neither the batch nor the corpus. Whole texts are encoded, whatever their length.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Where the public vocabularies lie; every function takes another place.
TOKENIZERS = "/opt/tokenizers"
NAME = "byte_bpe_50k"
#: Characters handed to the library at once.
GROUP_CHARS = 400_000

_loaded: dict[str, object] = {}


def load(name: str = NAME, folder: str = TOKENIZERS):
    """The tokenizer of a vocabulary file, once per process. Strings like special tokens are ordinary text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    path = f"{folder}/{name}.json"
    if path not in _loaded:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        t.no_padding()
        t.no_truncation()
        _loaded[path] = t
    return _loaded[path]


def _groups(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    places, group, size = [], [], 0
    for i, x in enumerate(texts):
        if x:
            places.append(i)
            group.append(x)
            size += len(x)
            if size >= GROUP_CHARS:
                yield places, group
                places, group, size = [], [], 0
    if group:
        yield places, group


def _lists(lengths: np.ndarray, values: np.ndarray) -> pa.Array:
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()))


def encode_arrays(texts: list[str | None], name: str = NAME, folder: str = TOKENIZERS) -> tuple[np.ndarray, np.ndarray]:
    """Token counts of the texts, and all ids in their order. Empty and null texts have none."""
    t = load(name, folder)
    lengths = np.zeros(len(texts), np.int64)
    parts: list[np.ndarray] = []
    for places, group in _groups(texts):
        found = [e.ids for e in t.encode_batch_fast(group, add_special_tokens=False)]
        sizes = list(map(len, found))
        lengths[places] = sizes
        parts.append(np.fromiter(chain.from_iterable(found), np.int32, sum(sizes)))
    return lengths, np.concatenate(parts) if parts else np.zeros(0, np.int32)


def count_tokens(texts: list[str | None], name: str = NAME, folder: str = TOKENIZERS) -> np.ndarray:
    """Token counts of the texts; ids are never built."""
    t = load(name, folder)
    lengths = np.zeros(len(texts), np.int64)
    for places, group in _groups(texts):
        lengths[places] = list(map(len, t.encode_batch_fast(group, add_special_tokens=False)))
    return lengths


def _kept(keep: list[str] | None, own: list[str]) -> list[str]:
    """The columns to keep; ValueError if one has a name of the result's own."""
    if clash := {n.lower() for n in own} & {c.lower() for c in keep or []}:
        raise ValueError(f"columns of the result can't be kept: {sorted(clash)}")
    return keep or []


def encode(df: DataFrame, text: str = "text", keep: list[str] | None = None, *, name: str = NAME, folder: str = TOKENIZERS, out: str = "ids") -> DataFrame:
    """`keep` columns of df and the ids of each text as `out` (array of int).

    An empty and a null text both have an empty list. Rows, repeated ones too, stay as they are; other columns are
    dropped before the data goes to Python.
    """
    keep = _kept(keep, [out])
    source = df.select(*keep, df[text].alias("__text"))
    schema = T.StructType([f for f in source.schema.fields if f.name != "__text"] + [T.StructField(out, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                lengths, ids = encode_arrays(part["__text"].to_pylist(), name, folder)
                yield pa.RecordBatch.from_arrays([part[c] for c in keep] + [_lists(lengths, ids)], names=[*keep, out])

    return source.mapInArrow(run, schema)


def token_counts(df: DataFrame, text: str = "text", keep: list[str] | None = None, *, name: str = NAME, folder: str = TOKENIZERS, out: str = "n_tokens") -> DataFrame:
    """`keep` columns of df and the number of tokens of each text as `out`; 0 for empty and null texts."""
    keep = _kept(keep, [out])
    source = df.select(*keep, df[text].alias("__text"))
    schema = T.StructType([f for f in source.schema.fields if f.name != "__text"] + [T.StructField(out, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths = count_tokens(b["__text"].to_pylist(), name, folder)
            yield pa.RecordBatch.from_arrays([b[c] for c in keep] + [pa.array(lengths, pa.int64())], names=[*keep, out])

    return source.mapInArrow(run, schema)


def encode_with_offsets(df: DataFrame, text: str = "text", keep: list[str] | None = None, *, name: str = NAME, folder: str = TOKENIZERS) -> DataFrame:
    """Like encode, with `starts` and `ends` of each token in characters of the text.

    A character whose bytes are split between tokens belongs to each of them: their offsets overlap.
    """
    keep = _kept(keep, ["ids", "starts", "ends"])
    source = df.select(*keep, df[text].alias("__text"))
    arrays = [T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("ids", "starts", "ends")]
    schema = T.StructType([f for f in source.schema.fields if f.name != "__text"] + arrays)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = load(name, folder)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = part["__text"].to_pylist()
                cols: list[list[list[int]]] = [[[] for _ in texts] for _ in range(3)]
                for places, group in _groups(texts):
                    for i, e in zip(places, t.encode_batch(group, add_special_tokens=False)):
                        cols[0][i] = e.ids
                        cols[1][i], cols[2][i] = ([x[k] for x in e.offsets] for k in (0, 1))
                yield pa.RecordBatch.from_arrays([part[c] for c in keep] + [pa.array(c, pa.list_(pa.int32())) for c in cols], names=[*keep, "ids", "starts", "ends"])

    return source.mapInArrow(run, schema)


def byte_table() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary, reversed."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def decoder(name: str = NAME, folder: str = TOKENIZERS):
    """A function from ids to text. Bytes are joined before they become characters, so split characters come back
    whole; bytes that form no character become U+FFFD. Unknown ids raise ValueError."""
    back = byte_table()
    pieces: dict[int, bytes] = {}
    t = load(name, folder)

    def decode_ids(ids) -> str:
        out = bytearray()
        for i in ids:
            i = int(i)
            if i not in pieces:
                token = t.id_to_token(i)
                if token is None:
                    raise ValueError(f"no token has the id {i}")
                pieces[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
            out += pieces[i]
        return out.decode("utf-8", "replace")

    return decode_ids


def decode(df: DataFrame, ids: str = "ids", keep: list[str] | None = None, *, name: str = NAME, folder: str = TOKENIZERS) -> DataFrame:
    """`keep` columns of df and the text of each list of ids; a null list has a null text, an empty one an empty text."""
    keep = _kept(keep, ["text"])
    source = df.select(*keep, df[ids].alias("__ids"))
    schema = T.StructType([f for f in source.schema.fields if f.name != "__ids"] + [T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = decoder(name, folder)
        for b in batches:
            texts = [None if x is None else back(x) for x in b["__ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b[c] for c in keep] + [pa.array(texts, pa.string())], names=[*keep, "text"])

    return source.mapInArrow(run, schema)
