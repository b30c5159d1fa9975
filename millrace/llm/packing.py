"""Sum-of-squares packing of documents into sequences of a fixed number of tokens.

A piece goes where the sum over gaps of the squared number of open sequences with that gap becomes smallest. Pieces come
largest first. Only documents longer than a sequence are cut; each full piece is a sequence.

Pieces are dealt by hash to groups of about GROUP_ROWS, each packed by one task that holds its pieces' lengths; a group
leaves a few sequences unfilled. Defined results: null and empty texts are one piece with the end token; ties go by key
and piece. Equal rows are packed each for itself. Extra columns are left out.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import given_back, pieces, quoted, remembered

#: Tokens of a sequence.
ROOM = 4096
#: Pieces of a group, about.
GROUP_ROWS = 1 << 17
#: Bytes that a worker remembers of parts of texts and their ids, about, while it packs; at more it forgets all.
KNOWN_BYTES = 96 << 20
STEP_BYTES = 1 << 20


def of_kind(kind: str) -> str:
    """The characters below U+0180 of a general category, for a character class."""
    return "".join(re.escape(chr(i)) for i in range(0x180) if unicodedata.category(chr(i))[0] == kind)


#: The tokenizer's own pattern, for texts of characters below U+0180.
PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{of_kind('L')}]+|[{of_kind('N')}]|[^\\s{of_kind('L')}{of_kind('N')}]+")
#: What other texts have: characters from U+0180 on, controls, and the capital whose small form is two characters.
OTHER = re.compile("[^\t-\r\x20-\x7e\xa0-\u012f\u0131-\u017f]")


class Encoder:
    """ids of texts as the library gives them. The tokenizer lower-cases, cuts by its pattern, drops white space, and encodes each
    part by itself; so a part is encoded once and its ids remembered, as bytes (little-endian, unsigned 32 bits). Texts with
    other characters than those below U+0180 are encoded by the library as a whole."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.size = Tokenizer.from_file(path), {}, 0

    def encode(self, texts: list[str]) -> list[bytes]:
        plain = [not OTHER.search(t) for t in texts]
        cut = [PARTS.findall(t.lower()) if p else () for t, p in zip(texts, plain)]
        if self.size > KNOWN_BYTES:
            self.known, self.size = {}, 0
        new = list(set().union(*cut).difference(self.known))
        for at in range(0, len(new), 1024):
            part = new[at : at + 1024]
            found = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            ids = np.array(found.ids, "<u4").tobytes()
            ends = (4 * np.cumsum(np.bincount(found.word_ids, minlength=len(part)))).tolist()
            self.known.update(zip(part, map(ids.__getitem__, map(slice, [0, *ends[:-1]], ends))))
            self.size += len(ids) + sum(map(len, part)) + 160 * len(part)  # two objects and their place in the dictionary
        whole = self.tokenizer.encode_batch_fast([t for t, p in zip(texts, plain) if not p], add_special_tokens=False)
        rest = (np.array(e.ids, "<u4").tobytes() for e in whole)
        return [b"".join(map(self.known.__getitem__, parts)) if p else next(rest) for parts, p in zip(cut, plain)]


def packed(lengths: np.ndarray, room: int = ROOM) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each length, placed in the order given; sequences count from 0."""
    count = np.zeros(room + 1, np.int64)  # of open sequences, by gap
    open_: list[list[int]] = [[] for _ in range(room + 1)]
    sequence, offset, used = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for i, n in enumerate(lengths.tolist()):
        # change of the sum when a gap g becomes g - n; a full sequence doesn't count
        change = 2 * (count[: room - n + 1] - count[n:] + 1)
        change[0] -= 2 * count[0] + 1
        change[count[n:] == 0] = np.iinfo(np.int64).max
        change[-1] = 2 * count[room - n] + 1 if n < room else 0
        gap = int(change.argmin()) + n
        if gap < room:
            s = open_[gap].pop()
            count[gap] -= 1
        else:
            s, used = used, used + 1
        sequence[i], offset[i] = s, room - gap
        if gap > n:
            count[gap - n] += 1
            open_[gap - n].append(s)
    return sequence, offset


def cut(df: DataFrame, path: str, end: int = 1, key: str = "doc_id", text: str = "text", room: int = ROOM) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of each piece; `ids` of a piece are 32-bit numbers of its text and the end token."""

    def run(batches):
        given_back(path)
        mark, encoder = np.array([end], "<u4").tobytes(), remembered(path, lambda: Encoder(path))
        for b in pieces(batches, "t", STEP_BYTES):
            rows = []
            for k, ids in zip(b.column("k").to_pylist(), encoder.encode([t or "" for t in b.column("t").to_pylist()])):
                ids += mark
                for i, at in enumerate(range(0, len(ids), 4 * room)):
                    part = ids[at : at + 4 * room]
                    rows.append((k, i, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (b.schema.field("k").type, pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])
        given_back(path)

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(quoted(key)).alias("k"), F.col(quoted(text)).alias("t")).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def in_sequences(df: DataFrame, path: str, end: int = 1, key: str = "doc_id", text: str = "text", room: int = ROOM, group_rows: int = GROUP_ROWS) -> DataFrame:
    """The pieces of cut() with sequence_id and offset."""
    groups = max(1, round(df.count() / group_rows))
    parts = cut(df, path, end, key, text, room)
    kind = df.schema[key].dataType.simpleString()

    def pack(group, rows):
        rows = rows.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        sequence, offset = packed(rows.column("length").to_numpy(), room)
        return rows.drop_columns(["pack_group"]).append_column("sequence_id", pa.array(sequence + (group[0].as_py() << 40))).append_column("offset", pa.array(offset))

    dealt = parts.withColumn("pack_group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)))
    return dealt.groupBy("pack_group").applyInArrow(pack, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
