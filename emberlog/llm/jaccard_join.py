"""N-gram Jaccard self-join of all texts: its links, each text's number of links, and its components.

Every text is the set of its distinct five-word shingles, as 64-bit hashes; texts of
one set are one class from the start. Sets link at a similarity of 0.8. All links
between classes are found, in two steps, each pair of classes in one of them:

1. Answers from similar sets. All classes that share a minimum hash are compared. A class's
   numbers of hashes shared with the others are derived from those of the closest class computed
   before it: hashes that both hold need no look, only those in which the two differ are
   looked up. Large groups are dealt in parts, and every two parts are compared by a task.
2. The rest, exactly. All classes' prefixes (the rarest fifth of a set in one common order) form
   index lists. An entry has its set's size and its token's position in the set's order; entries
   of one size and position are a block. Two blocks are skipped whole if size and position leave
   too few tokens for a link, and two sets that share a minimum hash are told apart there. Lists that
   are known to be long are dealt in parts, as above; one that turns out longer than planned is
   passed on unread and dealt in parts by its exact length in a second round. Pairs that are left are tried on
   counts of their hashes by ranges, which bound what they can share, and then verified.

Two linked sets of n and m hashes share o or more, o = 4/9 (n + m), and so a token among the first
n - o + 1 of the one and the first m - o + 1 of the other: no link is lost.

Sets are made of the texts again where they meet, as texts are shuffled packed, in about a third of a set's bytes.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, LOWER, NOT_SPACE, SLICE_BYTES, documents, forget, grams, hashes_of, in_batches, mix, slices, small, text_buffer, unused, words_of, written

WORDS = 5
SHARE = Fraction(4, 5)
SALTS = (0x0F, 0x2C7, 0x5A11, 0x91D3)  # of the minimum hashes
BLOCK = 2048  # classes of a minimum hash that are compared at once
BLOCK_HASHES = 2_000_000  # hashes of their sets in all, about
LIST = 4096  # entries of a token's list that meet in one part, about
LONG = 8  # times that many, and a list is dealt anew by its exact length
PAIRS = 1_000_000  # pairs of blocks or entries that are held at once, about
#: Tokens that a run of texts repeats often come last in the common order, by count. Any order is right; this keeps lists short.
ORDERED, REPEATED, RUN_BYTES = 400_000, 2, 20 << 20
_U = np.uint64


def sets_of(column: pa.Array):
    """Sorted distinct shingle hashes of all rows, one after the other, with n + 1 offsets."""
    data, off = text_buffer(column)
    data = LOWER[data]
    n = len(off) - 1
    starts, ends, owner = words_of(data, off, NOT_SPACE)
    h = hashes_of(data, starts, ends)
    g, at = grams(h, owner, WORDS)
    rows = owner[at]
    count = np.bincount(owner, minlength=n)
    first = np.searchsorted(owner, np.arange(n))
    for i in np.flatnonzero((count > 0) & (count < WORDS)):  # the whole sequence is one shingle
        own = h[first[i] : first[i] + count[i]]
        total = _U(count[i]) * np.ones(1, _U)
        for x in own:
            total = mix(total + x)
        g, rows = np.append(g, total), np.append(rows, i)
    order = np.lexsort((g, rows))
    g, rows = g[order], rows[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (rows[1:] != rows[:-1])
    g, rows = g[new], rows[new]
    return g, np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))]).astype(np.int64)


def _per_set(ufunc, values: np.ndarray, off: np.ndarray, empty: int) -> np.ndarray:
    out = np.full(len(off) - 1, empty, values.dtype)
    full = off[1:] > off[:-1]
    if full.any():
        out[full] = ufunc.reduceat(values, off[:-1][full])
    return out


def signature(g: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A hash of each whole set; it names the class."""
    return mix(_per_set(np.add, mix(g ^ _U(0xA5A5)), off, 0) + np.diff(off).astype(_U)).astype(np.int64)


RANGE = 4  # hashes of a set in each range that is counted, or up to twice as many


def sketches(g: np.ndarray, off: np.ndarray) -> pa.Array:
    """For each set the numbers of its hashes in 2^k equal ranges, a byte each; k goes by the set's size, 255 stands for more, too."""
    n = np.diff(off)
    k = np.minimum(np.frexp(np.maximum(n // RANGE, 1))[1] - 1, 20).astype(np.int64)
    to = np.concatenate([[0], np.cumsum(1 << k)])
    row = np.repeat(np.arange(len(n)), n)
    at = to[row] + (g >> _U(44) >> (20 - k[row]).astype(_U)).astype(np.int64)
    counts = np.minimum(np.bincount(at, minlength=to[-1]), 255).astype(np.uint8)
    return pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(to), pa.py_buffer(counts)]).cast(pa.binary())


def _most_shared(x: np.ndarray, y: np.ndarray) -> int | None:
    """No fewer than the hashes that two sets share, by their sketches; None where these don't tell."""
    if (x == 255).any() or (y == 255).any():
        return None
    size = min(len(x), len(y))
    x, y = (c.reshape(size, -1).sum(axis=1, dtype=np.int64) for c in (x, y))
    return int(np.minimum(x, y).sum())


def _linked(both, a, b):
    """both: size of the intersection; a, b: of the sets."""
    return both * SHARE.denominator >= (a + b - both) * SHARE.numerator


def _describe(docs: DataFrame) -> DataFrame:
    """doc_id, n, class, a minimum hash for each round, and the sketch; and, with null n, the repeated tokens of runs (in class) and counts (in m0)."""
    names = ["doc_id", "n", "class", *(f"m{k}" for k in range(len(SALTS))), "sketch"]

    def scan(batches):
        runs, size = [], 0

        def repeated():
            if not runs:
                return
            token, count = np.unique(np.concatenate(runs), return_counts=True)
            some = count >= REPEATED
            token, count = token[some].astype(np.int64), count[some].astype(np.int64)
            for at in range(0, len(token), 20_000):
                t, c = token[at : at + 20_000], count[at : at + 20_000]
                no = pa.nulls(len(t), pa.int64())
                yield pa.RecordBatch.from_arrays([no, no, pa.array(t), pa.array(c), *[no] * (len(SALTS) - 1), pa.nulls(len(t), pa.binary())], names)

        for batch in batches:
            for part in slices(batch):
                g, off = sets_of(part.column("text"))
                mins = [(_per_set(np.minimum, mix(g ^ _U(s)), off, 0) | _U(1)).astype(np.int64) for s in SALTS]  # never 0
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(np.diff(off)), pa.array(signature(g, off)), *map(pa.array, mins), sketches(g, off)], names)
                runs.append(g)
                size += len(g)
                if 8 * size > RUN_BYTES:
                    yield from repeated()
                    runs, size = [], 0
        yield from repeated()

    return in_batches(docs).select("doc_id", "text").mapInArrow(scan, ", ".join(f"{x} long" for x in names[:-1]) + ", sketch binary")


EDGES = 200_000  # of a file


def components(edges: DataFrame) -> DataFrame:
    """node, comp: the smallest node of each node's component; edges a, b. By large-star and small-star steps, until all are stars."""
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    files = 1 + edges.count() // EDGES
    while True:
        # a star: each outer node has one edge, and no centre is an outer node
        ends = edges.select(F.col("a").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("centre")).union(edges.select("b", F.lit(0), F.lit(1)))
        ends = ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("centre").alias("centre"))
        if ends.where("out > 1 or out = 1 and centre = 1").isEmpty():
            break
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = written(large.where("a <> b").distinct().coalesce(files), "large")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        star = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        before, edges = edges, written(star.where("a <> b").distinct().coalesce(files), "star")
        forget(before, large)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("comp"))


def _packed(df: DataFrame) -> DataFrame:
    """Its text as packed bytes (packed) and their number before (size); other columns, all long, as they are."""
    rest = [c for c in df.columns if c != "text"]

    def scan(batches):
        codec = pa.Codec("zstd")
        for batch in batches:
            for part in slices(batch):
                data, off = text_buffer(part.column("text"))
                packed = [codec.compress(data[a:b].tobytes(), asbytes=True) for a, b in zip(off[:-1], off[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*map(part.column, rest), pa.array(np.diff(off)), pa.array(packed, pa.binary())], [*rest, "size", "packed"])

    return in_batches(df).select(*rest, "text").mapInArrow(scan, ", ".join(f"{c} long" for c in [*rest, "size"]) + ", packed binary")


def _unpacked(batches):
    """Batches of packed rows with their text, in runs of SLICE_BYTES of it or of one row."""
    codec = pa.Codec("zstd")
    for batch in batches:
        total, at = np.concatenate([[0], np.cumsum(batch.column("size").to_numpy())]), 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(total, total[at] + SLICE_BYTES, "right")) - 1)
            part = batch.slice(at, to - at)
            data = b"".join(codec.decompress(x.as_buffer(), int(n), asbytes=True) for x, n in zip(part.column("packed"), np.diff(total[at : to + 1]), strict=True))
            text = pa.Array.from_buffers(pa.large_string(), to - at, [None, pa.py_buffer(total[at : to + 1] - total[at]), pa.py_buffer(data)])
            rest = [c for c in part.schema.names if c not in ("size", "packed")]
            yield pa.RecordBatch.from_arrays([*map(part.column, rest), text], [*rest, "text"])
            at = to


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """class and its set as bytes, of the classes wanted (class, doc_id); classes once."""
    ids = written(wanted.select("doc_id").distinct(), "wanted")

    def scan(batches):
        for batch in batches:
            for part in slices(batch):
                g, off = sets_of(part.column("text"))
                sets = pa.Array.from_buffers(pa.large_binary(), part.num_rows, [None, pa.py_buffer(off * 8), pa.py_buffer(np.ascontiguousarray(g).view(np.uint8))])
                yield pa.RecordBatch.from_arrays([pa.array(signature(g, off)), sets.cast(pa.binary())], ["class", "set"])

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(small(ids), "doc_id", "left_semi")
    return found.select("text").mapInArrow(scan, "class long, set binary")


def _shared(sets: list[np.ndarray], rows: int):
    """For each of the first sets, the numbers of hashes that it shares with all sets.

    The first is counted over the lists of its hashes; each other one takes the numbers of the closest
    set before it and corrects them by the lists of the hashes in which the two differ.
    """
    n = np.array([len(s) for s in sets])
    _, inv, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    live = count[inv] > 1
    column = (np.cumsum(count > 1) - 1)[inv[live]]
    owner = np.repeat(np.arange(len(sets)), n)[live]
    start = np.searchsorted(owner, np.arange(len(sets) + 1))
    held = owner[np.argsort(column, kind="stable")]
    size = count[count > 1]
    first = np.cumsum(size) - size

    def counted(tokens):
        own = size[tokens]
        at = np.repeat(first[tokens] - (np.cumsum(own) - own), own) + np.arange(own.sum())
        return np.bincount(held[at], minlength=len(sets)).astype(np.int32)

    both = np.zeros((rows, len(sets)), np.int32)
    closest, near = np.full(len(sets), -1), np.zeros(len(sets))
    for i in range(rows):
        own, r = column[start[i] : start[i + 1]], closest[i]
        whole = r < 0
        if not whole:
            other = column[start[r] : start[r + 1]]
            new, gone = np.setdiff1d(own, other, assume_unique=True), np.setdiff1d(other, own, assume_unique=True)
            whole = size[new].sum() + size[gone].sum() >= size[own].sum()
        both[i] = counted(own) if whole else both[r] + counted(new) - counted(gone)
        alike = both[i] / (n[i] + n - both[i])
        better = alike > near
        closest[better], near[better] = i, alike[better]
    return both, n


def _block_links(k: int, sets: list[np.ndarray], side: np.ndarray, keys: np.ndarray):
    """(i, all j linked to it) of one block; pairs that share a minimum hash before k are another block's."""
    cross = bool((side == 1).any())
    rows = int((side < 2).sum())
    both, n = _shared(sets, rows)
    for i in range(rows):
        lo = rows if cross else i + 1
        link = _linked(both[i, lo:].astype(np.int64), n[i], n[lo:])
        for m in range(k):
            link &= keys[lo:, m] != keys[i, m]
        j = lo + np.flatnonzero(link)
        if len(j):
            yield i, j


def _in_blocks(members: DataFrame, docs: DataFrame, every: bool) -> DataFrame:
    """Links among the members (block, k, side, class, doc_id, copies, m0..) of each block, as a, b.

    Every: all of them. Otherwise from each class to the first one of those linked to it in the block, directly or
    through others, and rows without b that give the copies linked to a.
    """
    keys = [f"m{k}" for k in range(len(SALTS))]
    members = members.select("doc_id", "block", "class", "k", "side", "copies", *keys)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    few = small(members, BROADCAST_ROWS // 4)  # of ten longs
    # more of them meet the texts by a shuffle, of packed texts
    joined = _packed(texts).join(members, "doc_id") if few is members else _packed(texts.join(few, "doc_id"))
    joined = joined.repartition("block").sortWithinPartitions("block", "side", "class")

    def scan(batches):
        now, rows, own = None, {}, []

        def links():
            if len(rows) < 2:
                return
            ids = np.array(list(rows), np.int64)
            of = np.array(list(rows.values()), np.int64)
            k, side, copies, met = int(of[0, 0]), of[:, 1], of[:, 2], of[:, 3:]
            if side.max() > 0 and side.min() == side.max():
                return
            degree, some, size, part = np.zeros(len(ids), np.int64), [], 0, np.arange(len(ids))
            for i, j in _block_links(k, own, side, met):
                degree[i] += copies[j].sum()
                degree[j] += copies[i]
                if not every:
                    of = np.unique(part[np.append(j, i)])
                    if len(of) > 1:
                        part[np.isin(part, of)] = of[0]
                    continue
                some.append((np.full(len(j), ids[i]), ids[j]))
                size += len(j)
                if size > 50_000:
                    yield table(some)
                    some, size = [], 0
            if some:
                yield table(some)
            if not every and (part != np.arange(len(part))).any():
                i = np.flatnonzero(part != np.arange(len(part)))
                yield table([(ids[part[i]], ids[i])])
            if not every and degree.any():
                at = np.flatnonzero(degree)
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.nulls(len(at), pa.int64()), pa.array(degree[at])], ["a", "b", "linked"])

        def table(some):
            a, b = (np.concatenate(x) for x in zip(*some, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64())], ["a", "b", "linked"])

        for batch in _unpacked(batches):
            g, off = sets_of(batch.column("text"))
            sign = signature(g, off).tolist()
            columns = [batch.column(c).to_pylist() for c in ("block", "class", "k", "side", "copies", *keys)]
            for i, (at, c, *rest) in enumerate(zip(*columns, strict=True)):
                if at != now:
                    yield from links()
                    now, rows, own = at, {}, []
                if c not in rows and c == sign[i]:  # an id may stand for other texts, too
                    rows[c] = rest
                    own.append(g[off[i] : off[i + 1]])
        yield from links()

    return joined.select("block", "class", "k", "side", "copies", *keys, "size", "packed").mapInArrow(scan, "a long, b long, linked long")


def _blocked(classes: DataFrame) -> DataFrame:
    """block, k, key, side, class, doc_id, copies, m0.. of the classes of shared minimum hashes.

    A block is a group (side 0) or two parts of a large one (sides 1 and 2). Groups whose
    classes all share an earlier minimum hash are left out.
    """
    names = [f"m{k}" for k in range(len(SALTS))]
    keys = F.explode(F.array(*(F.struct(F.lit(k).cast("long").alias("k"), F.col(m).alias("key")) for k, m in enumerate(names)))).alias("x")
    pool = classes.select(keys, "class", "doc_id", "n", "copies", *names).select("x.*", "class", "doc_id", "n", "copies", *names)
    same = F.lit(False)
    for k, m in enumerate(names[:-1]):
        same = same | ((F.col("k") > k) & (F.min(m) == F.max(m)))
    groups = pool.groupBy("k", "key").agg(F.count("*").alias("size"), F.sum("n").alias("hashes"), same.alias("same")).where("size > 1 and not same")
    most = F.greatest(F.col("size") / BLOCK, F.col("hashes") / BLOCK_HASHES)
    parts = F.when(most <= 1, 1).otherwise(F.least(F.ceil(2 * most), F.col("size"))).cast("long")
    groups = written(groups.select("k", "key", parts.alias("parts")), "groups")
    # large groups are few; their members stay where they are
    large, rest = small(groups.where("parts > 1")), groups.where("parts = 1")
    members = pool.join(large, ["k", "key"]).unionByName(pool.join(large, ["k", "key"], "left_anti").join(rest, ["k", "key"]))
    members = members.withColumn("part", F.pmod(F.xxhash64("class", "k"), "parts")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    side = F.when(F.col("part") == F.col("other"), 0).when(F.col("part") < F.col("other"), 1).otherwise(2).cast("long")
    block = F.xxhash64("k", "key", F.least("part", "other"), F.greatest("part", "other"))
    return members.select(block.alias("block"), "k", "key", side.alias("side"), "class", "doc_id", "copies", *names)


MET = tuple(f"b{k}" for k in range(len(SALTS)))
ENTRY = ("token", "side", "class", "n", "pos", *MET)


def _lists(docs: DataFrame, marks: DataFrame, order: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """ENTRY rows, one for each token in the prefix of each class; pos: the token's position, b0..: the shared minimum hashes.

    A long list is dealt in parts: every two parts (sides 1 and 2), and each part (side 0), are a list of their own.
    """
    shared = docs.sparkSession.sparkContext.broadcast(order)

    def scan(batches):
        known, rank_of = shared.value
        for batch in _unpacked(batches) if packed else batches:
            for part in slices(batch):
                g, off = sets_of(part.column("text"))
                n = np.diff(off)
                row = np.repeat(np.arange(part.num_rows), n)
                rank = np.zeros(len(g), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, g), len(known) - 1)
                    rank = np.where(known[at] == g, rank_of[at], 0)
                at = np.lexsort((g, rank, row))
                pos = np.arange(len(g)) - off[row]
                first = pos < (n - -(-n * SHARE.numerator // SHARE.denominator) + 1)[row]
                keep, row, pos, sig = at[first], row[first], pos[first], signature(g, off)
                blocks = [part.column(c).fill_null(0).to_numpy() for c in MET]
                token, parts = g[keep], 1 + rank[keep] // LIST
                for lo in range(0, len(keep), 50_000):
                    r, t, m, at = (x[lo : lo + 50_000] for x in (row, token, parts, pos))
                    side = np.zeros(len(t), np.int64)
                    if (m > 1).any():
                        own = (mix(sig[r].view(_U) ^ t) % m.astype(_U)).astype(np.int64)
                        other = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                        r, t, own, at, m = (np.repeat(x, m) for x in (r, t, own, at, m))
                        side = np.where(own == other, 0, np.where(own < other, 1, 2))
                        of = mix(t + mix((np.minimum(own, other) * m + np.maximum(own, other) + 1).astype(_U)))
                        t = np.where(m > 1, of, t)
                    for a in range(0, len(t), 50_000):
                        b = a + 50_000
                        yield pa.RecordBatch.from_arrays([pa.array(t[a:b].astype(np.int64)), pa.array(side[a:b]), pa.array(sig[r[a:b]]), pa.array(n[r[a:b]]), pa.array(at[a:b]), *(pa.array(x[r[a:b]]) for x in blocks)], list(ENTRY))

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    few = small(marks)
    packed = few is marks
    marked = (_packed(texts) if packed else texts).join(few, "doc_id", "left").where("coalesce(keep, true)")
    return marked.select(*(("size", "packed") if packed else ("text",)), *MET).mapInArrow(scan, ", ".join(f"{x} long" for x in ENTRY))


def _runs(count: np.ndarray):
    """Slices over which count sums to PAIRS at most, or of one element."""
    total, at = np.concatenate([[0], np.cumsum(count)]), 0
    while at < len(count):
        to = max(at + 1, int(np.searchsorted(total, total[at] + PAIRS, "right")) - 1)
        yield slice(at, to)
        at = to


def _expanded(first: np.ndarray, count: np.ndarray):
    """Index of the element and the place, for count places from first on of each element."""
    of = np.repeat(np.arange(len(count)), count)
    return of, first[of] + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)


def _list_pairs(x: list[np.ndarray]):
    """Index pairs (i, j) of the entries of whole lists (columns as ENTRY, ordered by token, n and pos) that may link and share no minimum hash."""
    token, side, klass, n, pos, *met = x
    num, den = SHARE.numerator, SHARE.denominator
    cut = np.flatnonzero(np.diff(token)) + 1
    lo, hi = np.append(0, cut), np.append(cut, len(token))
    some = hi - lo > 1
    for b in met:
        some &= (b[lo] == 0) | (np.minimum.reduceat(b, lo) != np.maximum.reduceat(b, lo))
    live = np.repeat(some, hi - lo)
    if not live.any():
        return
    at = np.flatnonzero(live)
    token, side, klass, n, pos, *met = (c[at] for c in x)
    # blocks of one list, size and position
    new = np.append(True, (np.diff(token) != 0) | (np.diff(n) != 0) | (np.diff(pos) != 0))
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(token)))
    own_list, bn, bpos = np.cumsum(np.append(True, np.diff(token[first]) != 0)), n[first], pos[first]
    width = int(bn.max()) * den // num + 2
    key = own_list * width + bn
    to = np.searchsorted(key, own_list * width + bn * den // num, "right")  # skip to the sizes that can link
    count = to - np.arange(len(first))
    for part in _runs(count):
        u, v = _expanded(np.arange(len(first))[part], count[part])
        u += part.start
        least = -(-(bn[u] + bn[v]) * num // (num + den))
        may = (bpos[u] + least <= bn[u]) & (bpos[v] + least <= bn[v]) & ((u != v) | (size[u] > 1))
        u, v = u[may], v[may]
        for pairs in _runs(size[u]):
            of, i = _expanded(first[u[pairs]], size[u[pairs]])
            begin, end = np.maximum(first[v[pairs]][of], i + 1), (first[v[pairs]] + size[v[pairs]])[of]
            for rows in _runs(end - begin):
                of, j = _expanded(begin[rows], (end - begin)[rows])
                k = i[rows][of]
                ok = (klass[k] != klass[j]) & ((side[k] == 0) | (side[k] != side[j]))
                for b in met:
                    ok &= (b[k] == 0) | (b[k] != b[j])
                if ok.any():
                    yield at[k[ok]], at[j[ok]]


def _met(lists: DataFrame, most: int | None) -> DataFrame:
    """Pairs of classes (class < other) that meet in a list; and, with null other, the entries of lists of more than most entries."""
    ordered = lists.repartition("token").sortWithinPartitions("token", "n", "pos")
    names = ["other", *ENTRY]

    def scan(batches):
        rest, passed = None, None

        def told(x):
            for i, j in _list_pairs(x):
                a, b = np.minimum(x[2][i], x[2][j]), np.maximum(x[2][i], x[2][j])
                for at in range(0, len(a), 50_000):
                    own, no = pa.array(a[at : at + 50_000]), pa.nulls(len(a[at : at + 50_000]), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(b[at : at + 50_000]), no, no, own, *[no] * (len(names) - 4)], names)

        def unread(x):
            return pa.RecordBatch.from_arrays([pa.nulls(len(x[0]), pa.int64()), *map(pa.array, x)], names)

        for batch in batches:
            x = [c.to_numpy() for c in batch.columns]
            if passed is not None:
                n = int(np.searchsorted(x[0], passed, "right"))
                if n:
                    yield unread([c[:n] for c in x])
                    x = [c[n:] for c in x]
                if len(x[0]):
                    passed = None
            if rest is not None:
                x = [np.concatenate(y) for y in zip(rest, x, strict=True)]
                rest = None
            if not len(x[0]):
                continue
            last = int(np.searchsorted(x[0], x[0][-1]))
            if last:
                yield from told([c[:last] for c in x])
            rest = [c[last:] for c in x]
            if most is not None and len(rest[0]) > most:
                yield unread(rest)
                passed, rest = int(rest[0][0]), None
        if rest is not None and len(rest[0]):
            yield from told(rest)

    return ordered.mapInArrow(scan, ", ".join(f"{x} long" for x in names))


def _dealt(entries: DataFrame) -> DataFrame:
    """The entries of long lists in parts of about LIST entries by exact counts; every two parts, and each part, are a list."""
    parts = entries.groupBy("token").agg(F.ceil(F.count("*") / LIST).cast("long").alias("parts"))
    own = entries.join(small(written(parts, "parts")), "token").withColumn("own", F.pmod(F.xxhash64("class", "token"), "parts"))
    own = own.withColumn("to", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    one = F.col("side") == 0
    side = F.when(~one, F.col("side")).when(F.col("own") == F.col("to"), 0).when(F.col("own") < F.col("to"), 1).otherwise(2)
    low = F.when(one, F.least("own", "to")).when(F.col("side") == 1, F.col("own")).otherwise(F.col("to"))
    high = F.when(one, F.greatest("own", "to")).when(F.col("side") == 1, F.col("to")).otherwise(F.col("own"))
    return own.select(F.xxhash64("token", low, high).alias("token"), side.cast("long").alias("side"), *ENTRY[2:])


def _candidates(lists: DataFrame) -> DataFrame:
    """a, b: pairs of classes without a shared minimum hash whose sizes and positions in some list allow a link."""
    made = written(_met(lists, LONG * LIST), "met")
    pairs, unread = made.where("other is not null"), made.where("other is null")
    if not unread.isEmpty():
        pairs = pairs.unionByName(written(_met(_dealt(unread.select(*ENTRY)), None), "met-long"))
    return pairs.select(F.col("class").alias("a"), F.col("other").alias("b")).distinct()


def _possible(pairs: DataFrame, counts: DataFrame) -> DataFrame:
    """The pairs that may link by their sketches (class, sketch), and all whose sketches don't tell."""
    joined = pairs.join(counts.select(F.col("class").alias("a"), F.col("sketch").alias("x")), "a").join(counts.select(F.col("class").alias("b"), F.col("sketch").alias("y")), "b")

    def scan(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint8), np.frombuffer(y.as_py(), np.uint8)
                most = _most_shared(x, y)
                ok.append(most is None or bool(_linked(most, int(x.sum(dtype=np.int64)), int(y.sum(dtype=np.int64)))))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return joined.select("a", "b", "x", "y").mapInArrow(scan, "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs that link."""
    joined = pairs.join(sets.select(F.col("class").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("class").alias("b"), F.col("set").alias("y")), "b")

    def scan(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_py(), _U), np.frombuffer(y.as_py(), _U)
                ok.append(bool(_linked(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y))))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return joined.select("a", "b", "x", "y").mapInArrow(scan, "a long, b long")


def _described(docs: DataFrame) -> tuple[DataFrame, DataFrame, tuple[np.ndarray, np.ndarray]]:
    """The rows, the classes (class, doc_id, copies, n, m0..), and the repeated tokens with their counts."""
    told = written(_describe(docs), "described")
    rows = told.where("n is not null")
    hot = told.where("n is null").groupBy("class").agg(F.sum("m0").alias("count")).orderBy(F.desc("count"), "class").limit(ORDERED).toArrow()
    token = hot.column("class").to_numpy().astype(np.int64).view(_U)
    at = np.argsort(token)
    usable = rows.where("doc_id is not null and n > 0")
    classes = usable.groupBy("class").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.max("n").alias("n"), *(F.max(f"m{k}").alias(f"m{k}") for k in range(len(SALTS))))
    return rows, written(classes, "classes"), (token[at], hot.column("count").to_numpy()[at])


def _links(docs: DataFrame, rows: DataFrame, classes: DataFrame, order, every: bool) -> DataFrame:
    """a, b, linked, as _in_blocks gives them, over all classes."""
    members = written(_blocked(classes), "members")
    first = written(_in_blocks(members, docs, every), "links")

    # only the class's smallest doc_id enters the lists, with the minimum hashes that it shares; none where an id stands for more than one class
    met = members.groupBy("class", "doc_id").agg(*(F.max(F.when(F.col("k") == k, F.col("key"))).alias(f"b{k}") for k in range(len(SALTS))))
    multi = rows.join(classes.where("copies > 1").select("class", F.col("doc_id").alias("rep")), "class")
    others = multi.where("doc_id <> rep").select("doc_id", F.lit(False).alias("keep")).join(classes.select("doc_id"), "doc_id", "left_anti")
    known = met.drop("class").withColumn("keep", F.lit(True)).unionByName(others, allowMissingColumns=True)
    twice = rows.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id", F.lit(True).alias("keep"), F.lit(True).alias("again"))
    known = known.unionByName(twice.join(classes.select("doc_id"), "doc_id", "left_semi"), allowMissingColumns=True)
    blocks = [F.when(F.max("again").isNull(), F.max(f"b{k}")).alias(f"b{k}") for k in range(len(SALTS))]
    marks = known.groupBy("doc_id").agg(F.max("keep").alias("keep"), *blocks)
    pairs = written(_candidates(_lists(docs.where("doc_id is not null"), written(marks, "marks"), order)), "pairs")
    ends = lambda of: written(of.select(F.col("a").alias("class")).union(of.select(F.col("b").alias("class"))).distinct().join(classes, "class"), "ends")
    told = small(ends(pairs).select("class", "doc_id"))
    pairs = written(_possible(pairs, rows.join(told, ["class", "doc_id"]).select("class", "sketch").dropDuplicates(["class"])).distinct(), "possible")
    own = ends(pairs)
    new = _verified(pairs, _texts(docs, own)).distinct()
    left, right = (own.select(F.col("class").alias(x), F.col("copies").alias(f"c{x}"), *(F.col(f"m{k}").alias(f"{x}{k}") for k in range(len(SALTS)))) for x in "ab")
    new = new.join(left, "a").join(right, "b").where(" and ".join(f"a{k} <> b{k}" for k in range(len(SALTS))))
    new = written(new.select("a", "b", "ca", "cb"), "new")
    out = first.unionByName(new.select("a", "b", F.lit(None).cast("long").alias("linked")))
    if every:
        return out
    none = F.lit(None).cast("long").alias("b")
    return out.unionByName(new.select("a", none, F.col("cb").alias("linked"))).unionByName(new.select(F.col("b").alias("a"), none, F.col("ca").alias("linked")))


def jaccard_links(docs: DataFrame) -> DataFrame:
    """Every link between two different sets, once: doc_id, other_id, n_copies and other_copies.

    doc_id and other_id are the smallest of each set's class, the smaller one first where they differ; the copies are the
    rows of the class, which all link to each other and to all rows of the other class. Rows that
    take no part are those of jaccard_components.
    """
    rows, classes, order = _described(docs)
    links = _links(docs, rows, classes, order, True)
    left, right = (classes.select(F.col("class").alias(x), F.struct("doc_id", "copies").alias(f"{x}_")) for x in "ab")
    both = links.join(left, "a").join(right, "b").select(F.least("a_", "b_").alias("x"), F.greatest("a_", "b_").alias("y"))
    return both.select("x.doc_id", F.col("y.doc_id").alias("other_id"), F.col("x.copies").alias("n_copies"), F.col("y.copies").alias("other_copies"))


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id linked) and n_links (the other rows linked to it) of every row.

    Null, empty or blank text: no shingles, no links, a component of its own. Fewer than five
    words: the whole sequence is the one shingle. A text of any length is one whole set. A null doc_id takes no part: its
    component is null, it has no links and nobody links through it. Rows of one doc_id keep a row each
    and count as rows. Other columns play no part; no rows give no rows.
    """
    rows, classes, order = _described(docs)
    found = _links(docs, rows, classes, order, False)
    comp = components(found.where("b is not null").select("a", "b"))
    linked = found.where("b is null").groupBy(F.col("a").alias("class")).agg(F.sum("linked").alias("linked"))

    labelled = classes.select("class", "doc_id", "copies").join(comp, classes["class"] == comp["node"], "left").select("class", "doc_id", "copies", F.coalesce("comp", "class").alias("comp"))
    least = labelled.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    n_links = (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    named = labelled.join(least, "comp").join(linked, "class", "left").select("class", "component_id", n_links)
    in_class = rows.where("n > 0 and doc_id is not null").join(named, "class").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "n_links")
    alone = rows.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return in_class.unionByName(alone)


def one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each component, that of the smallest doc_id, with all of its columns; of rows with that id, one."""
    found = written(jaccard_components(docs), "components")
    drop = written(found.where("component_id <> doc_id").select("doc_id").distinct(), "drop")
    kept = docs.join(small(drop), docs["doc_id"].cast("long") == drop["doc_id"], "left_anti")
    again = unused(docs, "again")
    twice = found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias(again))
    twice = written(twice, "twice")
    if twice.isEmpty():
        return kept
    one = kept.join(small(twice), F.col("doc_id") == F.col(again), "left_semi").dropDuplicates(["doc_id"])
    return kept.join(small(twice), F.col("doc_id") == F.col(again), "left_anti").unionByName(one)


def op9_jaccard_join(spark, sf_dir):
    return jaccard_components(documents(spark, sf_dir, "doc_id", "text"))
