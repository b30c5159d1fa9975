"""Near-duplicate classes by DartMinHash over weighted word shingles.

A document is the weighted set of its five-word shingles, weights being their counts. Darts fall on each shingle's region
(a Poisson process in weight x rank, seeded by the shingle); those below a rank set by the total weight are hashed to
coordinates, and each coordinate keeps its earliest dart. Two signatures agree in a coordinate with the probability of the
weighted Jaccard similarity. Bands of five coordinates are the buckets that give candidates; candidates are compared exactly.

In a bucket each text is compared with the bucket's most central text (the one whose buckets hold most). Links make
classes. Then, in each bucket that still holds several classes, the texts outside its largest class are compared with
all texts of other classes there. So no pair of different classes in a bucket stays uncompared, and a bucket of one class,
however large, gives a row for each text.

Equal texts are one node from the start, named by their smallest key, or by a hash of the text from NO_KEY on where all their
keys are null. Defined results: null texts are empty; all texts without a word are equal only if their text is; texts of one
to four words are one shingle; class_id is the smallest key of the class (null if all its keys are null). Keys are below
NO_KEY. Rows of one key share a class, even if their texts differ. A very long text is handled by itself. Extra
columns pass through (of the same name as a result: replaced).
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, fresh, given_back, others, pieces, quoted, saved, small_batches

#: Words of a shingle, and the weighted Jaccard similarity of a link.
SHINGLE, SIMILAR = 5, 0.8
#: Bands and coordinates of each: at 0.8 a pair misses all buckets with a probability of (1 - 0.8^5)^26 = 3e-5.
BANDS, ROWS = 26, 5
#: Share of equal coordinates below which a candidate isn't compared: five standard deviations below 0.8.
LEAST_EQUAL = 0.62
#: Bytes of text handled at once, and what a text counts beside its own: a short one takes as many darts as a long one.
STEP_BYTES, ROW_BYTES = 1 << 20, 1 << 10
#: Bytes of texts that are compared as a block with another.
BLOCK_BYTES = 1 << 18
#: Names of texts that no key names start here.
NO_KEY = 1 << 62
_C = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93)]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _C[0]
    x = (x ^ (x >> np.uint64(29))) * _C[1]
    return x ^ (x >> np.uint64(32))


@cache
def powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.r_[np.uint64(1), np.full(n - 1, _C[2])], dtype=np.uint64)


def cells(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(number of the text, cell) of all unit weights, sorted: the m-th occurrence of a shingle in its text is a cell."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    bounds = np.cumsum([len(t) + 1 for t in texts])
    space = (data == 32) | ((data >= 9) & (data <= 13))
    start = np.flatnonzero(~space & np.r_[True, space[:-1]])
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    length = np.diff(np.r_[start, len(data)])
    at = np.arange(start[0], len(data)) - np.repeat(start, length)
    longest = 1 << int(at.max() + 1).bit_length()
    word = mixed(np.add.reduceat(np.where(space[start[0] :], np.uint64(0), (data[start[0] :] + np.uint64(1)) * powers(longest)[at]), start - start[0]))
    of = np.searchsorted(bounds, start, "right")
    count = np.bincount(of, minlength=len(texts))
    first = np.cumsum(count) - count
    n = np.where(count >= SHINGLE, count - SHINGLE + 1, np.minimum(count, 1))
    doc = np.repeat(np.arange(len(texts)), n)
    begin = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    padded, end = np.r_[word, np.zeros(SHINGLE, np.uint64)], first[doc] + count[doc]
    shingle = np.zeros(len(doc), np.uint64)
    for i in range(SHINGLE):
        shingle += np.where(begin + i < end, padded[begin + i], np.uint64(i)) * _C[i]
    shingle = mixed(shingle)
    order = np.lexsort((shingle, doc))
    doc, shingle = doc[order], shingle[order]
    new = np.r_[True, (doc[1:] != doc[:-1]) | (shingle[1:] != shingle[:-1])]
    nth = np.arange(len(doc)) - np.maximum.accumulate(np.where(new, np.arange(len(doc)), 0))
    return doc, mixed(shingle + nth.astype(np.uint64) * _C[3])


def signatures(doc: np.ndarray, cell: np.ndarray, n: int, k: int = BANDS * ROWS) -> np.ndarray:
    """n x k earliest darts (0 where a text has no cell)."""
    weight = np.bincount(doc, minlength=n)
    limit = (k * np.log(k) + 2 * k) / np.maximum(weight, 1)
    out = np.zeros((n, k), np.uint64)
    todo = weight > 0
    while todo.any():
        live = todo[doc]
        d, c = doc[live], cell[live]
        rank, nth = np.zeros(len(d)), 0
        best = np.full(n * k, np.inf)
        thrown = []
        while len(d):
            dart = mixed(c + np.uint64(nth * int(_C[4]) % 2**64))
            rank = rank - np.log(((dart >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53)
            in_ = rank <= limit[d]
            d, c, rank, dart, nth = d[in_], c[in_], rank[in_], dart[in_], nth + 1
            slot = d * k + (mixed(dart) % np.uint64(k)).astype(np.int64)
            np.minimum.at(best, slot, rank)
            thrown.append((slot, rank, dart))
        for slot, r, dart in thrown:
            won = best[slot] == r
            out.reshape(-1)[slot[won]] = dart[won]
        empty = np.isinf(best.reshape(n, k)).any(1)
        todo, limit = todo & empty, limit * 2  # a coordinate without a dart: throw more
    return out


def hashed_bands(found: np.ndarray) -> np.ndarray:
    h = np.zeros(found.shape[:1] + (BANDS,), np.uint64) + np.arange(BANDS, dtype=np.uint64)
    for i in range(ROWS):
        h = mixed(h + found[:, i :: ROWS][:, :BANDS] * _C[i])
    return h.view(np.int64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(len(a) + len(b) - both, 1)


def signed(docs: DataFrame) -> DataFrame:
    """docs(id, h1, h2, body) to (id, h1, h2, bands, marks): a byte of each coordinate serves to estimate."""

    def sign(batches):
        given_back()
        for b in pieces(batches, "body", STEP_BYTES, ROW_BYTES):
            doc, cell = cells([t or b"" for t in b.column("body").to_pylist()])
            found = signatures(doc, cell, b.num_rows)
            bands, some = hashed_bands(found), np.bincount(doc, minlength=b.num_rows) > 0
            offsets = pa.array(np.r_[0, np.cumsum(some * BANDS)], pa.int32())
            marks = [m.tobytes() for m in mixed(found).astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("h1"), b.column("h2"), pa.ListArray.from_arrays(offsets, pa.array(bands[some].ravel())), pa.array(marks, pa.binary())], names=["id", "h1", "h2", "bands", "marks"])
        given_back()

    return docs.mapInArrow(sign, "id long, h1 long, h2 long, bands array<long>, marks binary")


def likely(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose coordinates agree enough."""

    def enough(batches):
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(b.num_rows, -1) for c in ("ma", "mb"))
                yield b.filter(pa.array((x == y).mean(1) >= LEAST_EQUAL)).select(["a", "b"])

    marks = nodes.select("id", "marks")
    with_a = pairs.join(marks.withColumnsRenamed({"id": "a", "marks": "ma"}), "a")
    return with_a.join(marks.withColumnsRenamed({"id": "b", "marks": "mb"}), "b").select("a", "b", "ma", "mb").mapInArrow(enough, "a long, b long")


def linked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of similar texts; texts(id, body)."""

    def compare(batches):
        for batch in batches:
            for b in pieces(pieces([batch], "ba", STEP_BYTES, ROW_BYTES), "bb", STEP_BYTES, ROW_BYTES):
                known = {}
                for i, t in [*zip(b.column("b").to_pylist(), b.column("bb").to_pylist()), *zip(b.column("a").to_pylist(), b.column("ba").to_pylist())]:
                    known.setdefault(i, t or b"")
                doc, cell = cells(list(known.values()))
                cut = np.searchsorted(doc, np.arange(len(known) + 1))
                of = {i: cell[cut[j] : cut[j + 1]] for j, i in enumerate(known)}
                good = [similarity(of[x], of[y]) >= SIMILAR for x, y in zip(b.column("a").to_pylist(), b.column("b").to_pylist())]
                yield b.filter(pa.array(good, pa.bool_())).select(["a", "b"])
        given_back()

    with_a = pairs.join(texts.withColumnsRenamed({"id": "a", "body": "ba"}), "a")
    both = with_a.join(texts.withColumnsRenamed({"id": "b", "body": "bb"}), "b")
    return both.select("a", "b", "ba", "bb").mapInArrow(compare, "a long, b long").distinct()


def crossing(rooted: DataFrame, texts: DataFrame) -> DataFrame:
    """The links (a, b) of different classes that share a bucket; rooted(bucket, id, root).

    The texts outside a bucket's largest class stand as queries against all texts of the bucket, both in blocks of about
    BLOCK_BYTES; a pair of blocks is compared at once and gives its links only."""
    sizes = rooted.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"))
    most = sizes.groupBy("bucket").agg(F.count(F.lit(1)).alias("classes"), F.max(F.struct("n", "root")).alias("most")).filter("classes > 1").select("bucket", F.col("most.root").alias("most"))
    open_ = rooted.join(most, "bucket").select("bucket", "id", "root", (F.col("root") != F.col("most")).alias("asks"))
    whole = open_.join(texts, "id")
    weight = whole.groupBy("bucket", "asks").agg(F.sum(F.octet_length("body") + 512).alias("w")).select("bucket", "asks", F.ceil(F.col("w") / BLOCK_BYTES).alias("blocks"))
    placed = whole.join(weight, ["bucket", "asks"]).withColumn("block", F.pmod(F.xxhash64("id"), "blocks"))
    blocks = placed.groupBy("bucket", "asks", "block").agg(F.collect_list(F.struct("id", "root", "body")).alias("rows"))
    asking = blocks.filter("asks").select("bucket", F.col("block").alias("mine"), F.col("rows").alias("ra"))
    pairs = asking.join(blocks.withColumnRenamed("rows", "rb"), "bucket").filter("not asks or block >= mine").select("ra", "rb")

    def compare(batches):
        for b in batches:
            for x, y in zip(b.column("ra"), b.column("rb")):
                yield pa.RecordBatch.from_arrays([*map(pa.array, links_between(*(pa.array(r.values) for r in (x, y))))], names=["a", "b"])
        given_back()

    return pairs.mapInArrow(compare, "a long, b long").distinct()


def links_between(x: pa.StructArray, y: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of similar texts of different roots of two blocks of (id, root, body)."""
    doc, cell = cells([t or b"" for t in (*x.field("body").to_pylist(), *y.field("body").to_pylist())])
    n, (ids, roots) = len(x), (np.concatenate([r.field(c).to_numpy() for r in (x, y)]) for c in ("id", "root"))
    weight = np.bincount(doc, minlength=len(ids)).astype(np.float32)
    left = doc < n
    met = np.isin(cell, np.intersect1d(cell[left], cell[~left]))
    doc, left, (known, at) = doc[met], left[met], np.unique(cell[met], return_inverse=True)
    columns = np.zeros((len(known), len(ids) - n), np.float32)
    columns[at[~left], doc[~left] - n] = 1
    step, found = max(1, (1 << 22) // max(len(known), 1)), []
    for first in range(0, n, step):
        mine = left & (doc >= first) & (doc < first + step)
        rows = np.zeros((min(step, n - first), len(known)), np.float32)
        rows[doc[mine] - first, at[mine]] = 1
        both = rows @ columns
        like = both >= SIMILAR * (weight[first : first + len(rows), None] + weight[None, n:] - both)
        i, j = np.nonzero(like & (both > 0) & (roots[first : first + len(rows), None] != roots[None, n:]))
        found.append((ids[i + first], ids[j + n]))
    a, b = (np.concatenate(c) for c in zip(*found))
    return np.minimum(a, b), np.maximum(a, b)


def components(links: DataFrame) -> DataFrame:
    """(id, root) of the nodes of links(a, b): root is the smallest id that links lead to. Labels hook and jump, in a logarithm of rounds."""
    both = checkpointed(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a != b").distinct())
    label = checkpointed(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("root")))
    while True:
        near = both.join(label.select(F.col("id").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("m"))
        seen = label.join(near.withColumnRenamed("a", "id"), "id").select("id", "root", F.least("root", "m").alias("m"))
        hooks = seen.groupBy("root").agg(F.min("m").alias("hook"))
        hooked = seen.join(hooks, "root").select("id", F.col("root").alias("was"), F.least("m", "hook").alias("root"))
        jump = hooked.select(F.col("id").alias("root"), F.col("root").alias("next"))
        new = checkpointed(hooked.join(jump, "root", "left").select("id", "was", F.least("root", F.coalesce("next", "root")).alias("root")))
        label = new.select("id", "root")
        if new.filter("was != root").isEmpty():
            return label


def classed(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`df` with class_id (the smallest key of its class) and is_kept (true for one row of each class)."""
    kept = others(df, ("class_id", "is_kept"))
    h1, h2, row = fresh(df, "text_hash", "text_hash_b", "row_id")
    body = F.coalesce(F.col(quoted(text)), F.lit(""))
    marked = df.withColumns({h1: F.xxhash64(body), h2: F.xxhash64(F.lit(7), body), row: F.monotonically_increasing_id()})
    named = F.coalesce(F.col(quoted(key)).cast("long"), F.col(h1).bitwiseAND(F.lit(NO_KEY - 1)) + F.lit(NO_KEY))
    plain = marked.select(named.alias("id"), F.col(h1).alias("h1"), F.col(h2).alias("h2"), body.cast("binary").alias("body"), F.col(row).alias("row"))
    first = plain.groupBy("h1", "h2").agg(F.min(F.struct("id", "row")).alias("f")).select("h1", "h2", F.col("f.id").alias("id"), F.col("f.row").alias("row"))
    signs = signed(plain.select("id", "h1", "h2", "body")).groupBy("h1", "h2").agg(F.min("id").alias("id"), F.first("bands").alias("bands"), F.first("marks").alias("marks"))
    nodes = checkpointed(signs.select("id", "h1", "bands", "marks"))
    buckets = nodes.select("id", F.explode("bands").alias("bucket"))
    full = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = checkpointed(buckets.join(full, "bucket"))
    central = checkpointed(members.groupBy("id").agg(F.sum("n").alias("c")))
    leaders = members.join(central, "id").groupBy("bucket").agg(F.max(F.struct("c", (-F.col("id")).alias("b"))).alias("l")).select("bucket", (-F.col("l.b")).alias("b"))
    pairs = members.join(leaders, "bucket").select(F.col("id").alias("a"), "b").filter("a != b").distinct()
    wanted = central.join(nodes.select("id", "h1"), "id").select("id", "h1")  # the texts that have a candidate
    bodies = plain.select("id", "h1", "body").join(wanted, ["id", "h1"]).dropDuplicates(["id", "h1"]).select("id", "body")
    with saved(bodies) as texts, small_batches(df.sparkSession):  # rows hold two texts, or two blocks of them
        links = checkpointed(linked(likely(pairs, nodes), texts))
        roots = components(links)
        rooted = checkpointed(members.join(roots, "id", "left").select("bucket", "id", F.coalesce("root", "id").alias("root")))
        more = checkpointed(crossing(rooted, texts))
    if not more.isEmpty():
        roots = components(links.union(more))
    of_class, of_row = fresh(marked, "class_of_text", "row_of_text")
    classes = first.join(roots, "id", "left").select("h1", "h2", "id", F.coalesce("root", "id").alias("root"), "row")
    keyed, kept_row = F.when(F.col("root") < NO_KEY, F.col("root")), F.when(F.col("root") == F.col("id"), F.col("row"))
    classes = checkpointed(classes.select(F.col("h1").alias(h1), F.col("h2").alias(h2), keyed.alias(of_class), kept_row.alias(of_row)))
    out = marked.select(*map(quoted, kept), h1, h2, row).join(classes, [h1, h2])
    return out.select(*map(quoted, kept), F.col(of_class).alias("class_id"), (F.col(row) == F.coalesce(F.col(of_row), F.lit(-1))).alias("is_kept"))
