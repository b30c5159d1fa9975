"""Byte-level BPE from a file of ranks, and its inverse.

Bytes map to characters (printable ones to themselves, the rest from U+0100 on); merges follow from ranks. Decoding maps
characters back to bytes, which may hold parts of a character; `text_of` joins such parts over calls.

ids come from the tiktoken library, which takes a third of the CPU time of the tokenizers library. That one gives offsets, and the
ids of texts with very long runs of white space, for which tiktoken's search for the pattern runs out of its stack.

Defined results: null texts are empty and have no ids. Extra columns pass through (of the same name as a result: replaced).
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import json
import os
import re
from collections.abc import Iterable, Iterator
from functools import cache, cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, others, pieces, quoted

#: Bytes of text encoded at once.
STEP_BYTES = 1 << 19
#: White space in a row from which on a text is the tokenizers library's.
LONG_BLANK = 1 << 14


@cache
def characters() -> list[str]:
    """By byte: its character."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def halves(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes]:
    """The two tokens that the merge of this one joins: what merges of smaller ranks make of its bytes."""
    parts, own = [token[i : i + 1] for i in range(len(token))], ranks[token]
    while len(parts) > 2:
        at = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], own))
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts[0], parts[1]


def described(path: str, pattern: str) -> str:
    """The tokenizer as the library's JSON; its size is the vocabulary's."""
    ranks = read_ranks(path)
    say = lambda b: "".join(characters()[x] for x in b)
    merges = [[*map(say, halves(t, ranks))] for t in sorted(ranks, key=ranks.get) if len(t) > 1]
    model = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": True, "vocab": {say(t): i for t, i in ranks.items()}, "merges": merges}
    cut = {"type": "Split", "pattern": {"Regex": pattern}, "behavior": "Isolated", "invert": False}
    level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": False}
    return json.dumps({"version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [cut, level]}, "post_processor": None, "decoder": None, "model": model})


class Codec:
    def __init__(self, description: str):
        import tiktoken

        self.description, parts = description, json.loads(description)
        back = {c: b for b, c in enumerate(characters())}
        self.bytes_of = {i: bytes(back[c] for c in t) for t, i in parts["model"]["vocab"].items()}
        pattern = parts["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks={b: i for i, b in self.bytes_of.items()}, special_tokens={})
        self.blank = re.compile(rf"\s{{{LONG_BLANK}}}")

    @cached_property
    def tokenizer(self):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        return Tokenizer.from_str(self.description)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self.ids_of(t) for t in texts]

    def ids_of(self, text: str) -> list[int]:
        if len(text) >= LONG_BLANK and self.blank.search(text):
            return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
        return self.encoding.encode_ordinary(text)

    def encode_with_offsets(self, text: str) -> list[tuple[int, int, int]]:
        """(id, start, end), in code points; tokens that split a character both have it."""
        e = self.tokenizer.encode(text, add_special_tokens=False)
        return [(i, a, b) for i, (a, b) in zip(e.ids, e.offsets)]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def text_of(self, parts: Iterable[Iterable[int]]) -> Iterator[str]:
        """The text of parts of a list of ids, a character that parts split coming with the later part."""
        whole = codecs.getincrementaldecoder("utf-8")("replace")
        for ids in parts:
            yield whole.decode(self.decode(ids))
        yield whole.decode(b"", True)


@cache
def codec(description: str) -> Codec:
    return Codec(description)


def tokenized(df: DataFrame, path: str, pattern: str, text: str = "text", ids: bool = True) -> DataFrame:
    """`df` with token_ids (if ids), n_tokens, ids_sha256 (of decimal ids joined by a space) and decoded_sha256."""
    description = df.sparkSession.sparkContext.broadcast(described(path, pattern))  # as large as the vocabulary file
    added = [*["token_ids"] * ids, "n_tokens", "ids_sha256", "decoded_sha256"]
    kept = others(df, added)
    (whole,) = fresh(df, "whole_text")

    def run(batches):
        c = codec(description.value)
        for b in pieces(batches, whole, STEP_BYTES):
            found = c.encode([t or "" for t in b.column(whole).to_pylist()])
            hashed = [hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest() for x in found]
            back = [hashlib.sha256(c.decode(x)).hexdigest() for x in found]
            columns = [*[pa.array(found, pa.list_(pa.int32()))] * ids, pa.array([len(x) for x in found], pa.int64()), pa.array(hashed, pa.string()), pa.array(back, pa.string())]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in kept), *columns], names=[*kept, *added])

    kinds = {"token_ids": T.ArrayType(T.IntegerType()), "n_tokens": T.LongType()}
    schema = T.StructType([*(df.schema[c] for c in kept), *(T.StructField(c, kinds.get(c, T.StringType())) for c in added)])
    return df.select(*map(quoted, kept), F.col(quoted(text)).alias(whole)).mapInArrow(run, schema)
