"""Removal of repeated passages by suffix sorting (bucket-pointer refinement).

Suffixes start in buckets of equal q-grams, named by the q-gram itself. Buckets are taken up one after another, a batch at a
time, and each is refined by sorting its suffixes on the identifiers of the buckets that their later offsets are in, again
and again until it is done. A refined bucket's identifiers hold from then on, so that later buckets which look at them
go deeper by what is already known there (`refined`). Neighbours in the resulting order are compared byte by byte.

Over a cluster: each window of `least` bytes is dealt to the initial bucket of its smallest 16-gram (by hash). A run of
windows in one document with the same bucket travels as two hashes, once for each block of documents. Where runs of one
bucket differ but agree in the bytes before or behind the gram, the windows that reach there are refined in their block,
and a hash of each distinct window travels. So a bucket gets a row for each block at most from whatever is common, and a
window is compared over all documents. Texts of different blocks never meet: they are equal if 104 bits of hash are (at
10^14 windows a wrong match is expected once in 10,000 such jobs).

A byte is removed if a string of `least` bytes that covers it also starts in a document with a smaller key. Strings
are those of the input. Defined results: null texts are empty; documents shorter than `least` lose nothing; rows of the
same key, in whatever block they lie, don't remove from each other; a null key counts as larger than all others. A
document is the unit of work: a very long text is a block of its own. Rows are dealt by their place in the input, so the
input must give its rows in the same order when it is read again, as tables do. Extra columns pass through (of the same
name as a result: replaced).
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, given_back, others, quoted

#: Bytes of a string that counts as repeated.
LEAST = 50
#: Bytes of the grams that name initial buckets over the cluster.
GRAM = 16
#: Bytes of text in a block of documents, about; a worker holds one.
BLOCK_BYTES = 2 << 20
#: Bytes of text whose runs, or windows, a part gets, about.
PART_BYTES = 4 << 20
#: Flanks that no other has, and that every other has.
NONE, ANY = 0, 65535
#: What a block is told of a run: a smaller key has the whole of it; windows that reach half a string before, or behind,
#: the gram are to be compared.
WHOLE, BEFORE, BEHIND = 1, 2, 4
#: Suffixes whose buckets are refined together.
BATCH = 1 << 17
NO_KEY = np.iinfo(np.int64).max
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = (x ^ (x >> np.uint64(31))) * _M1
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


def all_words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number, in the machine's order; the last seven places have none."""
    n = len(data) - 7
    out = np.empty(n, np.uint64)
    for k in range(8):
        out[k::8] = np.frombuffer(data, "<u8", len(range(k, n, 8)), k)
    return out


def heads(*columns: np.ndarray) -> np.ndarray:
    """Where a row of sorted columns differs from the row before it."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = False
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def refined(words: np.ndarray, starts: np.ndarray, depth: int, batch: int = BATCH) -> tuple[np.ndarray, np.ndarray]:
    """(order, group): the places in `starts` by their first `depth` bytes (a multiple of nothing, 8 at least), and, in that
    order, the number of each's group of equal ones. words: all_words() of the bytes, which go on for `depth` after each
    start; starts ascend, without repeats."""
    n = len(starts)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    index = np.full(int(starts[-1]) + depth + 1, -1, np.int32)  # of a place among the starts
    index[starts] = np.arange(n)
    gram = words[starts].byteswap()
    order = np.argsort(gram, kind="stable").astype(np.int32)
    new = heads(gram[order])
    del gram
    pointer = np.empty(n, np.int32)  # of each start: where its bucket begins in the order
    pointer[order] = np.maximum.accumulate(np.where(new, np.arange(n, dtype=np.int32), 0))
    known = np.full(n, 8, np.int32)  # of each start: bytes that its bucket's members are known to share
    first = np.flatnonzero(new)
    size = np.diff(np.r_[first, n])
    first, size = first[size > 1], size[size > 1]
    turn = (np.cumsum(size) - size) // batch
    for bounds in np.split(np.arange(len(first)), np.flatnonzero(np.diff(turn)) + 1):
        f, z = first[bounds], size[bounds]
        at = np.repeat(f, z) + np.arange(z.sum()) - np.repeat(np.cumsum(z) - z, z)  # places in the order
        while len(at):
            own = order[at]
            bucket = pointer[own]
            begin = np.flatnonzero(heads(bucket))
            step = np.minimum(known[own], depth - 8)
            later = starts[own] + step
            there = index[later]
            # a bucket whose later places are all starts is sorted on their pointers, else on the grams' identifiers
            all_there = np.repeat(np.logical_and.reduceat(there >= 0, begin), np.diff(np.r_[begin, len(at)]))
            name = words[later].byteswap()
            name[all_there] = pointer[there[all_there]]
            gain = np.full(len(at), 8, np.int32)
            gain[all_there] = known[there[all_there]]
            by = np.lexsort((name, bucket))
            own, bucket, name, reached = own[by], bucket[by], name[by], (step + gain)[by]
            order[at] = own
            new = heads(bucket, name)
            pointer[own] = np.maximum.accumulate(np.where(new, at, 0))
            known[own] = np.minimum(reached, depth)
            part = np.flatnonzero(new)
            wide = np.diff(np.r_[part, len(at)])
            at = at[np.repeat(wide > 1, wide) & (reached < depth)]
    # pointers may have told bytes apart that lie beyond the depth: neighbours are compared in their own bytes
    new = np.ones(n, bool)
    new[1:] = False
    place = starts[order]
    for o in [*range(0, depth - 8, 8), depth - 8]:
        w = words[place + o]
        new[1:] |= w[1:] != w[:-1]
    return order.astype(np.int64), np.cumsum(new) - 1


def slid(x: np.ndarray, width: int, f) -> np.ndarray:
    """f (minimum or maximum) over each `width` values in a row."""
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = f(out[:-step], out[step:])
        have += step
    return out


@dataclass
class Block:
    """Documents laid end to end, and the runs of windows that share an initial bucket.

    A run: start (place of its first window), size (windows), entry. Entries are the distinct runs: bucket, content, the
    smallest key, a run of it (head), and the flanks."""

    words: np.ndarray
    bounds: np.ndarray
    keys: np.ndarray
    start: np.ndarray
    size: np.ndarray
    owner: np.ndarray
    entry: np.ndarray
    bucket: np.ndarray
    content: np.ndarray
    key: np.ndarray
    head: np.ndarray
    left: np.ndarray
    right: np.ndarray
    anchor: np.ndarray


def string_hash(words: np.ndarray, at: np.ndarray, length: int, seed: int = 0) -> np.ndarray:
    h = np.full(len(at), length + (seed << 32), np.uint64)
    for o in [*range(0, length - 8, 8), length - 8]:
        h = mixed(h * _M2 + words[at + o])
    return h


def smallest_grams(words: np.ndarray, n: int, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By window start the smallest hash of its grams; all places of such grams, and their hashes. In steps that fit a cache."""
    low, places, hashes, step = np.zeros(max(0, n - reach + 1), np.uint64), [], [], 1 << 15
    for at in range(0, len(low), step):
        end = min(at + step, len(low))
        start = max(0, at - reach + 1)  # a gram at `at` may be the smallest of a window that starts so far before
        grams = mixed(words[start : end + reach - 1] * _M2 + words[start + 8 : end + reach + 7])
        part = slid(grams, reach, np.minimum)
        low[at:end] = part[at - start :]
        most = slid(np.r_[np.zeros(reach - 1, np.uint64), part, np.zeros(reach - 1, np.uint64)], reach, np.maximum)
        hit = np.flatnonzero(most == grams)
        hit = hit[(hit >= at - start) & ((hit < end - start) | (end == len(low)))]
        places.append(hit + start)
        hashes.append(grams[hit])
    return low, *(np.concatenate(x) if x else np.zeros(0, t) for x, t in ((places, np.int64), (hashes, np.uint64)))


def laid_out(texts: list[bytes], keys: np.ndarray, least: int = LEAST) -> Block:
    data = np.frombuffer(b"".join(texts) + b"\0" * 64, np.uint8)
    words = all_words(data)
    bounds = np.r_[0, np.cumsum([len(t) for t in texts], dtype=np.int64)]
    n, reach = int(bounds[-1]), least - GRAM + 1
    low, places, grams = smallest_grams(words, n, reach)
    # where the smallest gram changes, or a document begins; from there on to the next such place, or the document's last window
    turns = np.union1d(np.flatnonzero(np.r_[True, low[1:] != low[:-1]][: len(low)]), bounds[:-1])
    turns = turns[turns < n]
    of = np.searchsorted(bounds, turns, "right") - 1
    ends = np.minimum(np.r_[turns[1:], n], bounds[of + 1] - least + 1)
    begins, ends, of = (x[ends > turns] for x in (turns, ends, of))
    # runs of more windows than a string has bytes are cut, so the first and last window hold all bytes of a run
    parts = -(-(ends - begins) // least)
    start = np.repeat(begins, parts) + least * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
    size = np.minimum(np.repeat(ends, parts) - start, least)
    owner, bucket = np.repeat(of, parts), low[start]
    content = mixed(string_hash(words, start, least) + mixed(string_hash(words, start + size - 1, least) + size.astype(np.uint64)))
    name = mixed(content) + bucket
    order = np.argsort(name, kind="stable")  # documents lie by key, so the first run of a name has its smallest key
    new = heads(name[order])
    first = np.empty(len(order), np.int64)
    first[order] = order[new][np.cumsum(new) - 1]
    head = np.flatnonzero(first == np.arange(len(first)))
    entry = np.searchsorted(head, first)
    left, right, anchor = flanks(words, places, grams, start[head], size[head], bucket[head], least)
    return Block(words, bounds, keys, start, size, owner, entry, bucket[head], content[head], keys[owner[head]], head, left, right, anchor)


def flanks(words: np.ndarray, places: np.ndarray, grams: np.ndarray, start: np.ndarray, size: np.ndarray, bucket: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, right, anchor) of runs: hashes of the bytes beside the run's gram, which is at anchor. Two windows that are equal
    have half of their other bytes, or more, equal before the gram or behind it. NONE: the run hasn't so many there;
    ANY: the gram occurs twice."""
    half, end = (least - GRAM + 1) // 2, start + size - 1 + least
    anchor, count = np.full(len(start), -1), np.zeros(len(start), np.int64)
    live = np.arange(len(start))
    at = np.searchsorted(places, start)
    while len(live):
        inside = at < len(places)
        inside[inside] &= places[at[inside]] + GRAM <= end[live[inside]]
        live, at = live[inside], at[inside]
        same = grams[at] == bucket[live]
        anchor[live[same & (count[live] == 0)]] = places[at[same & (count[live] == 0)]]
        count[live[same]] += 1
        at += 1
    out = []
    for at, there in ((anchor - half, anchor - half >= start), (anchor + GRAM, anchor + GRAM + half <= end)):
        h = string_hash(words, np.where(there, at, 0), half)
        out.append(np.where(count > 1, ANY, np.where(there, h % np.uint64(ANY - 1) + np.uint64(1), NONE)).astype("<u2"))
    return out[0], out[1], anchor


def open_windows(b: Block, status: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The windows to compare: their starts (ascending), their keys, and the number of each's group of equal ones."""
    e = np.flatnonzero(status > WHOLE)
    size, first = b.size[b.head[e]], b.start[b.head[e]]
    starts = np.repeat(first, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    before = np.repeat(b.anchor[e], size) - starts >= (least - GRAM + 1) // 2
    told = np.repeat(status[e], size)
    asked = (before & (told & BEFORE > 0)) | (~before & (told & BEHIND > 0)) | (told == BEFORE + BEHIND)
    starts, keys = starts[asked], np.repeat(b.key[e], size)[asked]
    order, sorted_group = refined(b.words, starts, least)
    group = np.empty(len(starts), np.int64)
    group[order] = sorted_group
    return starts, keys, group


def settled(b: Block, status: np.ndarray, starts: np.ndarray, keys: np.ndarray, group: np.ndarray, smallest: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which bytes are covered by strings that this block knows to be repeated, starts of windows whose group another block may
    know, those groups' numbers)."""
    of = np.full(len(b.words), -1, np.int32)  # of a place: its window among those compared
    of[starts] = np.arange(len(starts))
    part = status[b.entry]
    own = b.keys[b.owner] == b.key[b.entry]
    whole = (part == WHOLE) | ~own
    mark = np.zeros(len(b.words) + 1, np.int32)
    np.add.at(mark, b.start[whole], 1)
    np.add.at(mark, b.start[whole] + b.size[whole] + least - 1, -1)
    some = np.flatnonzero((part > WHOLE) & own)
    size = b.size[some]
    place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    window = of[np.repeat(b.start[b.head[b.entry[some]]], size) + place]
    at = (np.repeat(b.start[some], size) + place)[window >= 0]
    window = window[window >= 0]
    hit = smallest[group[window]] < keys[window]
    np.add.at(mark, at[hit], 1)
    np.add.at(mark, at[hit] + least, -1)
    return np.cumsum(mark, out=mark)[: b.bounds[-1]] > 0, at[~hit], group[window[~hit]]


def covered(known: np.ndarray, at: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Which bytes to remove: those known, and those that windows at these places cover."""
    mark = np.zeros(len(known) + 1, np.int32)
    np.add.at(mark, at, 1)
    np.add.at(mark, at + least, -1)
    return known | (np.cumsum(mark, out=mark)[:-1] > 0)


def packed(alike: list[np.ndarray], *random: np.ndarray) -> bytes:
    """Columns that compress, compressed where it pays, then columns of hashes as they are."""
    body = b"".join(np.ascontiguousarray(c).tobytes() for c in alike)
    small = zlib.compress(body, 1) if len(body) > 256 else body
    return len(small).to_bytes(4, "little") + small + b"".join(np.ascontiguousarray(c).tobytes() for c in random)


def unpacked(body: bytes, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the two kinds of columns; size: of the first kind."""
    n = int.from_bytes(body[:4], "little")
    first = body[4 : 4 + n]
    return np.frombuffer(zlib.decompress(first) if size > 256 else first, np.uint8), np.frombuffer(body, np.uint8, offset=4 + n)


def low_bytes(x: np.ndarray, width: int) -> np.ndarray:
    """The low bytes of each number."""
    return np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :width]


def dealt(names: np.ndarray, parts: int) -> np.ndarray:
    return ((names >> np.uint64(40)) % np.uint64(parts)).astype(np.int64)


def by_part(part_of: np.ndarray) -> np.ndarray:
    return np.argsort(part_of.astype(np.uint16) if len(part_of) and part_of.max() < 1 << 16 else part_of, kind="stable")


def sent(block: int, part_of: np.ndarray, keys: np.ndarray, alike: list[np.ndarray], random: list[np.ndarray]) -> pa.Table:
    """A row for each part that occurs: the keys (as differences) and columns of the entries dealt to it, in their order."""
    order = by_part(part_of)
    first = np.flatnonzero(heads(part_of[order])) if len(order) else order
    rows = []
    for a, z in zip(first, np.r_[first[1:], len(order)]):
        at = order[a:z]
        rows.append((int(part_of[at[0]]), block, len(at), packed([np.diff(keys[at], prepend=0), *(c[at] for c in alike)], *(c[at] for c in random))))
    return table_of(SENT, rows)


def table_of(schema: str, rows: list[tuple]) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows)) or [[]] * len(fields)
    return pa.table({name: pa.array(c, kinds[kind]) for (name, kind), c in zip(fields, columns)})


SENT = "part long, block long, n long, body binary"
ANSWER = "block long, part long, n long, body binary"
#: Bytes of the hashes of entries: of a run's bucket and its content, of a window (in two numbers).
RUN_BYTES, WINDOW_BYTES = (5, 8), (8, 5)


def answered(rows: pa.Table, values: np.ndarray) -> pa.Table:
    n = rows.column("n").to_numpy()
    cut = np.r_[0, np.cumsum(n)]
    bodies = [packed([values[a:z].astype(np.uint8)]) for a, z in zip(cut, cut[1:])]
    return pa.table({"block": rows.column("block"), "part": rows.column("part"), "n": rows.column("n"), "body": pa.array(bodies, pa.binary())})


def opened(rows: pa.Table, alike: tuple[int, ...], random: tuple[int, ...]) -> tuple[np.ndarray, ...]:
    """The keys, and the columns as numbers of so many bytes, of all rows."""
    keys, out = [], [[] for _ in (*alike, *random)]
    for n, body in zip(rows.column("n").to_pylist(), rows.column("body").to_pylist()):
        first, rest = unpacked(body, n * (8 + sum(alike)))
        keys.append(np.cumsum(first[: n * 8].view("<i8")))
        for raw, widths, into, at in ((first, alike, out, n * 8), (rest, random, out[len(alike) :], 0)):
            for c, w in zip(into, widths):
                c.append(raw[at : at + n * w].reshape(n, w))
                at += n * w
    return np.concatenate(keys), *(number(np.concatenate(c)) for c in out)


def number(raw: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, : raw.shape[1]] = raw
    return wide.view("<u8")[:, 0]


def runs_met(rows):
    """What to tell of each run: see WHOLE, BEFORE, BEHIND. 0: no smaller key has a string of it."""
    key, left, right, bucket, content = opened(rows, (2, 2), RUN_BYTES)
    order = np.lexsort((key, content, bucket))
    bk, ct, ky = bucket[order], content[order], key[order]
    one = np.r_[True, bk[1:] != bk[:-1]]
    run = one | np.r_[True, ct[1:] != ct[:-1]]
    in_bucket, in_run = (np.cumsum(one) - 1)[run], np.cumsum(run) - 1
    least, sides = ky[run], (left[order][run], right[order][run])  # of each distinct run
    low, high = np.minimum.reduceat(least, np.flatnonzero(one[run])), np.maximum.reduceat(least, np.flatnonzero(one[run]))
    any_ = np.bincount(in_bucket, weights=(sides[0] == ANY) | (sides[1] == ANY)) > 0
    told = np.where((any_ & (low < high))[in_bucket], BEFORE + BEHIND, 0)
    for bit, side in zip((BEFORE, BEHIND), sides):
        by = np.lexsort((side, in_bucket))
        new = np.r_[True, (in_bucket[by][1:] != in_bucket[by][:-1]) | (side[by][1:] != side[by][:-1])]
        low, high = np.minimum.reduceat(least[by], np.flatnonzero(new)), np.maximum.reduceat(least[by], np.flatnonzero(new))
        met = (low < high)[np.cumsum(new) - 1] & (side[by] != NONE)
        told[by[met]] |= bit
    back = np.empty(len(order), np.int64)
    back[order] = np.where(ky > least[in_run], WHOLE, told[in_run])
    return answered(rows, back)


def windows_met(rows: pa.Table) -> pa.Table:
    """1 if a smaller key has the same window. What a block has put aside for itself (part below 0) goes back to it."""
    if rows.column("part")[0].as_py() < 0:
        return rows.select(["block", "part", "n", "body"])
    key, name, more = opened(rows, (), WINDOW_BYTES)
    order = np.lexsort((key, more, name))
    new = heads(name[order], more[order])
    back = np.empty(len(order), np.int64)
    back[order] = key[order] > key[order][new][np.cumsum(new) - 1]
    return answered(rows, back)


def replies(answers: pa.Table, part_of: np.ndarray) -> np.ndarray:
    """The answers in the order of the entries that were sent."""
    out = np.zeros(len(part_of), np.uint8)
    order = by_part(part_of)
    ordered = part_of[order]
    for p, n, body in zip(*(answers.column(c).to_pylist() for c in ("part", "n", "body"))):
        if p >= 0:
            a = int(np.searchsorted(ordered, p))
            out[order[a : a + n]] = unpacked(body, n)[0]
    return out


def put_aside(block: int, known: np.ndarray, at: np.ndarray, group: np.ndarray, part_of: np.ndarray) -> pa.Table:
    """What settled() has found, and the parts that groups are sent to, as one row for the block itself."""
    steps = np.concatenate([np.diff(x, prepend=0) for x in (at, group)]).astype("<i4")
    planes = [np.ascontiguousarray(part_of.astype("<u4").view(np.uint8)[i::4]) for i in range(4)]  # by byte: most are zero
    body = zlib.compress(b"".join(x.tobytes() for x in (np.packbits(known), steps, *planes)), 1)
    return table_of(SENT, [(-1 - block, block, len(at), body)])


def taken_up(answers: pa.Table, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(known, at, group, part_of) of put_aside(); n: bytes of the block."""
    row = int(np.flatnonzero(answers.column("part").to_numpy() < 0)[0])
    raw, m, at = np.frombuffer(zlib.decompress(answers.column("body")[row].as_py()), np.uint8), answers.column("n")[row].as_py(), -(-n // 8)
    steps = np.frombuffer(raw[at : at + 8 * m].tobytes(), "<i4")
    planes = raw[at + 8 * m :].reshape(4, -1).astype(np.int64)
    part_of = planes[0] + (planes[1] << 8) + (planes[2] << 16) + (planes[3] << 24)
    return np.unpackbits(raw[:at], count=n).astype(bool), np.cumsum(steps[:m], dtype=np.int64), np.cumsum(steps[m:], dtype=np.int64), part_of


def deduplicated(df: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, block_bytes: int = BLOCK_BYTES, parts: int | None = None, as_text: bool = False) -> DataFrame:
    """`df` with kept_bytes (binary, what is left), n_bytes, n_removed and n_spans (long). as_text: with kept_text, without the
    bytes of characters that a cut has split, in place of kept_bytes."""
    spark = df.sparkSession
    added = ("kept_text" if as_text else "kept_bytes", "n_bytes", "n_removed", "n_spans")
    names = [c for c in others(df, added) if c != text]
    total = df.agg(F.coalesce(F.sum(F.octet_length(quoted(text))), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_bytes))
    parts = parts or max(2, -(-total // PART_BYTES))
    block, body, order = fresh(df, "dedup_block", "dedup_body", "dedup_key")
    # both readers below have this same exchange, which Spark makes once. Not by key: rows of one key may be many
    place = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks))
    carried = [F.col(quoted(c)).alias(f"{block}_{i}") for i, c in enumerate(names)]
    dealt_docs = df.select(place.alias(block), F.col(quoted(key)).cast("long").alias(order), F.col(quoted(text)).cast("binary").alias(body), *carried)
    dealt_docs = dealt_docs.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), block)

    def read(docs: pa.Table) -> tuple[pa.Table, list[bytes], np.ndarray]:
        keys = docs.column(order).fill_null(NO_KEY).to_numpy()
        texts = [t or b"" for t in docs.column(body).to_pylist()]
        by = sorted(range(len(texts)), key=lambda i: (keys[i], texts[i]))  # the same in every step, in whatever order rows come
        return docs.take(pa.array(by, pa.int64())), [texts[i] for i in by], keys[by]

    def frugal(f):
        def run(*args):
            try:
                return f(*args)
            finally:
                given_back()

        return run

    def tell_runs(key_, docs):
        b = laid_out(*read(docs)[1:], least)
        return sent(key_[0].as_py(), dealt(b.bucket, parts), b.key, [b.left, b.right], [low_bytes(x, n) for x, n in zip((b.bucket, b.content), RUN_BYTES)])

    def tell_windows(key_, docs, answers):
        if not docs.num_rows:
            return table_of(SENT, [])
        b = laid_out(*read(docs)[1:], least)
        status = replies(answers, dealt(b.bucket, parts))
        starts, keys, group = open_windows(b, status, least)
        # groups by their first window; documents lie by key, so it has the group's smallest key
        _, first = np.unique(group, return_index=True)
        first.sort()
        again = np.empty(len(first), np.int64)
        again[group[first]] = np.arange(len(first))
        group, smallest = again[group], keys[first]
        name, more = string_hash(b.words, starts[first], least, 1), string_hash(b.words, starts[first], least, 2)
        part_of = dealt(name, parts)
        aside = put_aside(key_[0].as_py(), *settled(b, status, starts, keys, group, smallest, least), part_of)
        return pa.concat_tables([aside, sent(key_[0].as_py(), part_of, smallest, [], [low_bytes(x, n) for x, n in zip((name, more), WINDOW_BYTES)])])

    fields = [T.StructField(c, df.schema[c].dataType) for c in names]
    schema = T.StructType([*fields, T.StructField(added[0], T.StringType() if as_text else T.BinaryType()), *(T.StructField(c, T.LongType()) for c in added[1:])])

    def take_away(key_, docs, answers):
        docs, texts, _ = read(docs)
        bounds = np.r_[0, np.cumsum([len(t) for t in texts], dtype=np.int64)]
        known, at, group, part_of = taken_up(answers, int(bounds[-1])) if texts else (np.zeros(0, bool), *[np.zeros(0, np.int64)] * 3)
        gone = covered(known, at[replies(answers, part_of)[group] > 0], least)
        rows = [(np.frombuffer(t, np.uint8), gone[a:z]) for t, a, z in zip(texts, bounds, bounds[1:])]
        out = [docs.column(f"{block}_{i}") for i in range(len(names))]
        left = [d[~g].tobytes() if g.any() else t for t, (d, g) in zip(texts, rows)]
        out += [pa.array([x.decode("utf-8", "ignore") for x in left], pa.string()) if as_text else pa.array(left, pa.binary())]
        out += [pa.array(x, pa.int64()) for x in ([len(g) for _, g in rows], [int(g.sum()) for _, g in rows], [int(g[:1].sum() + (g[1:] & ~g[:-1]).sum()) for _, g in rows])]
        return pa.Table.from_arrays(out, names=[*names, *added])

    grouped = dealt_docs.groupBy(block)
    runs = grouped.applyInArrow(lambda k, d: frugal(tell_runs)(k, d), SENT)
    first = runs.groupBy("part").applyInArrow(lambda r: frugal(runs_met)(r), ANSWER)
    windows = grouped.cogroup(first.groupBy("block")).applyInArrow(lambda k, d, a: frugal(tell_windows)(k, d, a), SENT)
    second = windows.groupBy("part").applyInArrow(lambda r: frugal(windows_met)(r), ANSWER)
    return grouped.cogroup(second.groupBy("block")).applyInArrow(lambda k, d, a: frugal(take_away)(k, d, a), schema)
