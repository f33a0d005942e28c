"""Exact joins of similar sets: counted columns, rarest-first prefixes, blocked sparse products.

A set is an array of distinct 64-bit hashes; a column of the incidence matrix is all sets that hold a hash. Sets
are similar from Jaccard ``t`` on. The steps, each over all rows:

1. ``incidence``: rows are taken in batches; every batch sends its distinct sets' entries to the range of hashes
   they belong to, packed. A column that many sets of one batch hold is sent once with their number, so a hash
   that a third of all rows share costs one entry a batch.
2. ``counted``: a range counts its columns. Entries of columns that one set alone holds can't link anything and
   end here; the others return to their batch with the class of their column's frequency. One batch is told that
   it owns a set that several have, so copies go no further.
3. ``indexed``: with its columns ordered by rarity, a set of ``s`` that reaches ``t`` with another shares one of
   its first ``s - ceil(t * s) + 1`` columns with it (entries that ended in step 2 count as the rarest).
   Sets of which all of these are their own are alone; the others keep the shared part of their entries.
4. ``components_of``: within a column of this index, sets meet if their sizes and the places of the column leave
   room for the overlap that ``t`` needs. Only spanning forests of these meetings leave a task, never pairs;
   what they connect is a superset of what is similar. Columns of very many sets are linked in order of size.
5. ``placed``, ``overlaps``: components are multiplied out in blocks, rare columns as index lists and frequent
   ones as a dense strip; counts below what the sizes need are discarded. What leaves the task is the number
   of links of each set and a forest of them.

Nothing is sampled, and nothing that reaches ``t`` is lost. Two different sets get one key with a probability
of n^2 / 2^65 among n.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, broadcast_small, cut, mix, releasing
from .graph import components, forest

#: A batch ends after so many entries or rows (and ``PART_ROWS`` at most). What a batch holds of one column beyond ``_OFTEN`` sets is sent as a number.
_BATCH_ENTRIES, _BATCH_ROWS, _OFTEN = 1_200_000, 40_000, 16
#: Most rows that an ``Extract`` gives at once.
PART_ROWS = 20_000
#: Pairs and multiply-adds that one numpy step expands; sets in a column from which on it is linked as a chain.
_STEP, _CHAIN = 1 << 20, 256
_MANY = np.uint16(0xFFFF)

#: ``(id, ref, sets, keys)`` out of a record batch: for every row the set and a key that is equal for equal rows.
Extract = Callable[[pa.RecordBatch], Iterator[tuple[pa.Array, pa.Array, list[np.ndarray], np.ndarray | None]]]


def set_keys(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit key of every set: equal sets have equal keys."""
    sums = np.concatenate([[U64(0)], np.cumsum(mix(flat ^ U64(0x5851F42D4C957F2D)))])
    ends = np.cumsum(sizes)
    return mix(sums[ends] - sums[ends - sizes] + sizes.astype(np.uint64)).view(np.int64)


def _planes(values: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize)[:, :width].T).tobytes()


def pack(values: np.ndarray, *columns: np.ndarray) -> bytes:
    """Ascending 64-bit values as differences, and further columns, byte by byte of their numbers."""
    steps = np.diff(values, prepend=values[:1])
    width = max(1, -(-int(steps.max()).bit_length() // 8)) if len(values) else 1
    body = _planes(steps, width) + b"".join(_planes(c, c.itemsize) for c in columns)
    return struct.pack("<IQB", len(values), int(values[0]) if len(values) else 0, width) + zstandard.ZstdCompressor(level=1).compress(body)


def unpack(raw: bytes, *kinds: type) -> list[np.ndarray]:
    n, first, width = struct.unpack_from("<IQB", raw)
    if not n:
        return [np.zeros(0, np.uint64), *(np.zeros(0, k) for k in kinds)]
    body = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[13:]), np.uint8)
    at = 0

    def column(kind: type, width: int) -> np.ndarray:
        nonlocal at
        wide = np.zeros((n, np.dtype(kind).itemsize), np.uint8)
        wide[:, :width] = body[at : at + n * width].reshape(width, n).T
        at += n * width
        return wide.view(kind).ravel()

    values = np.cumsum(column(np.uint64, width), dtype=np.uint64) + U64(first)
    return [values, *(column(k, np.dtype(k).itemsize) for k in kinds)]


def _bucket(values: np.ndarray, buckets: int) -> np.ndarray:
    return ((values >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int32)


def _slices(sorted_keys: np.ndarray) -> Iterator[tuple[int, int]]:
    if len(sorted_keys):
        start = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])).tolist()
        yield from zip(start, [*start[1:], len(sorted_keys)])


_SENT = pa.schema([("bucket", pa.int32()), ("batch", pa.int64()), ("docs", pa.binary()), ("posts", pa.binary()), ("keys", pa.binary())])
_DOCS = pa.schema([("id", pa.int64()), ("ref", pa.int64()), ("k", pa.int64()), ("size", pa.int32())])


def _table(rows: pa.RecordBatch, often: bytes) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(rows)
    return struct.pack("<I", len(often)) + often + sink.getvalue().to_pybytes()


def incidence(rows: DataFrame, extract: Extract, buckets: int) -> DataFrame:
    """The packed entries of every batch, ``(bucket, batch, docs, posts, keys)``; rows with an empty set are left out."""

    def sent(batch: int, ids: list, refs: list, sets: list[np.ndarray], given: list) -> pa.RecordBatch:
        sizes = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate(sets)
        keys = set_keys(flat, sizes) if given[0] is None else np.concatenate(given)
        _, own = np.unique(keys, return_index=True)  # the first of the copies within the batch
        docs = pa.RecordBatch.from_arrays([pa.concat_arrays(ids), pa.concat_arrays(refs), pa.array(keys), pa.array(sizes.astype(np.int32))], schema=_DOCS)
        if len(own) < len(sets):
            keep = np.zeros(len(sets), bool)
            keep[own] = True
            flat = flat[np.repeat(keep, sizes)]
            doc = np.repeat(np.flatnonzero(keep), sizes[keep]).astype(np.uint16)
        else:
            doc = np.repeat(np.arange(len(sets), dtype=np.uint16), sizes)
        order = np.argsort(flat, kind="stable")
        flat, doc = flat[order], doc[order]
        start = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
        n = np.diff(np.append(start, len(flat)))
        many = np.repeat(n > _OFTEN, n)
        often = pack(flat[many], doc[many])
        single = ~many
        head = start[n > _OFTEN]
        single[head] = True
        times = np.zeros(len(flat), np.uint16)  # beyond the first
        times[head] = (n[n > _OFTEN] - 1).astype(np.uint16)
        doc[head] = _MANY
        flat, doc, times = flat[single], doc[single], times[single]
        ks = keys[own].view(np.uint64)
        by = np.argsort(ks)
        ks, at = ks[by], own[by].astype(np.uint16)
        parts: dict[int, list] = {}
        for values, place, cols in ((flat, 1, (doc, times)), (ks, 2, (at,))):
            b = _bucket(values, buckets)
            for lo, hi in _slices(b):
                parts.setdefault(int(b[lo]), [None, None, None])[place] = pack(values[lo:hi], *(c[lo:hi] for c in cols))
        parts.setdefault(batch % buckets, [None, None, None])[0] = _table(docs, often)
        names = list(parts)
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array([batch] * len(names), pa.int64()), *(pa.array([parts[x][c] for x in names], pa.binary()) for c in range(3))], schema=_SENT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[list] = [[], [], [], []]
        entries = 0
        for batch in batches:
            for ids, refs, sets, keys in extract(batch):
                full = np.array([len(s) > 0 for s in sets], bool)
                if not full.any():
                    continue
                mask = pa.array(full)
                held[0].append(ids.filter(mask))
                held[1].append(refs.filter(mask))
                sets = [s for s in sets if len(s)]
                held[2] += sets
                held[3].append(None if keys is None else keys[full])
                entries += sum(map(len, sets))
                if entries >= _BATCH_ENTRIES or len(held[2]) >= _BATCH_ROWS:
                    yield sent(number, *held)
                    number, held, entries = number + 1, [[], [], [], []], 0
        if held[2]:
            yield sent(number, *held)

    return rows.mapInArrow(releasing(run), "bucket int, batch long, docs binary, posts binary, keys binary")


def counted(sent: DataFrame, buckets: int) -> DataFrame:
    """``(batch, docs, posts, own)``: what each range of hashes returns to the batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["batch", "docs", "posts", "own"]
        of, posts, kof, keys = [], [], [], []
        for batch in batches:
            _, number, docs, post, key = batch.columns
            there = docs.is_valid()
            if there.true_count:
                d, b = docs.filter(there), number.filter(there)
                yield pa.RecordBatch.from_arrays([b, d, pa.nulls(len(b), pa.binary()), pa.nulls(len(b), pa.binary())], names)
            for b, p, k in zip(number.to_pylist(), post, key):
                if p.is_valid:
                    of.append(b)
                    posts.append(unpack(p.as_py(), np.uint16, np.uint16))
                if k.is_valid:
                    kof.append(b)
                    keys.append(unpack(k.as_py(), np.uint16))
        for b, own in _owners(kof, keys):
            yield pa.RecordBatch.from_arrays([pa.array([b]), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), pa.array([own.tobytes()])], names)
        if not posts:
            return
        lens = [len(p[0]) for p in posts]
        g, doc, n = (np.concatenate([p[c] for p in posts]) for c in range(3))
        posts.clear()
        at = np.repeat(np.argsort(np.argsort(of)).astype(np.int32), lens)
        order = np.argsort(g, kind="stable")
        g, doc, at = g[order], doc[order], at[order]
        n = n[order].astype(np.int64) + 1
        start = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        df = np.add.reduceat(n, start)
        each = np.diff(np.append(start, len(g)))
        kind = np.minimum(255, 8 * np.log2(df)).astype(np.uint8)
        keep = np.repeat(df > 1, each)
        g, doc, at, kind = g[keep], doc[keep], at[keep], np.repeat(kind, each)[keep]
        order = np.argsort(at, kind="stable")
        g, doc, at, kind = g[order], doc[order], at[order], kind[order]
        of = sorted(of)
        for lo, hi in _slices(at):
            yield pa.RecordBatch.from_arrays([pa.array([of[at[lo]]]), pa.nulls(1, pa.binary()), pa.array([pack(g[lo:hi], doc[lo:hi], kind[lo:hi])]), pa.nulls(1, pa.binary())], names)

    return sent.repartitionById(buckets, "bucket").mapInArrow(releasing(run), "batch long, docs binary, posts binary, own binary")


def _owners(of: list[int], keys: list[list[np.ndarray]]) -> Iterator[tuple[int, np.ndarray]]:
    """For each batch the rows whose set it owns: of the batches that have a set, the lowest."""
    if not keys:
        return
    k, row = (np.concatenate([x[c] for x in keys]) for c in range(2))
    batch = np.repeat(np.array(of, np.int64), [len(x[0]) for x in keys])
    order = np.lexsort((batch, k))
    k, row, batch = k[order], row[order], batch[order]
    first = np.concatenate([[True], k[1:] != k[:-1]])
    row, batch = row[first], batch[first]
    order = np.argsort(batch, kind="stable")
    row, batch = row[order], batch[order]
    for lo, hi in _slices(batch):
        yield int(batch[lo]), row[lo:hi]


_INDEX = "id long, ref long, k long, size int, alone int, prefix int, sig array<long>"


def indexed(returned: DataFrame, t: float) -> DataFrame:
    """A row for every row that has a set, ``(id, ref, k, size, alone, prefix, sig)``.

    ``sig`` holds the entries that other sets have too, rarest first, ``alone`` is the number of the others, and the
    first ``prefix`` of ``sig`` are the index; ``sig`` is empty where the prefix is, and for all copies but one.
    """

    def rows(docs: bytes, posts: list[bytes], owns: list[bytes]) -> Iterator[pa.RecordBatch]:
        n = struct.unpack_from("<I", docs)[0]
        often_g, often_doc = unpack(docs[4 : 4 + n], np.uint16)
        table = pa.ipc.open_stream(docs[4 + n :]).read_all().combine_chunks().to_batches()[0]
        size = table.column(3).to_numpy().astype(np.int64)
        own = np.zeros(len(size), bool)
        for raw in owns:
            own[np.frombuffer(raw, np.uint16)] = True
        parts = [unpack(p, np.uint16, np.uint8) for p in posts] or [[np.zeros(0, np.uint64), np.zeros(0, np.uint16), np.zeros(0, np.uint8)]]
        g, doc, kind = (np.concatenate([p[c] for p in parts]) for c in range(3))
        many = doc == _MANY
        if many.any():
            lo, hi = np.searchsorted(often_g, g[many]), np.searchsorted(often_g, g[many], side="right")
            m = hi - lo
            at = np.repeat(lo, m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            g, doc, kind = np.concatenate([g[~many], often_g[at]]), np.concatenate([doc[~many], often_doc[at]]), np.concatenate([kind[~many], np.repeat(kind[many], m)])
        keep = own[doc]
        g, doc, kind = g[keep], doc[keep], kind[keep]
        shared = np.bincount(doc, minlength=len(size))
        alone = size - shared
        prefix = np.where(own, np.clip(size - np.ceil(size * t - 1e-9).astype(np.int64) + 1 - alone, 0, shared), 0)
        keep = prefix[doc] > 0
        g, doc, kind = g[keep], doc[keep], kind[keep]
        order = np.lexsort((g, kind, doc))
        g = g[order].view(np.int64)
        ends = np.concatenate([[0], np.cumsum(np.where(prefix > 0, shared, 0))])
        for lo in range(0, len(size), 5000):
            hi = min(lo + 5000, len(size))
            sig = pa.ListArray.from_arrays(pa.array((ends[lo : hi + 1] - ends[lo]).astype(np.int32)), pa.array(g[ends[lo] : ends[hi]]))
            part = table.slice(lo, hi - lo)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(alone[lo:hi].astype(np.int32)), pa.array(prefix[lo:hi].astype(np.int32)), sig], ["id", "ref", "k", "size", "alone", "prefix", "sig"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for b, *got in zip(batch.column(0).to_pylist(), *batch.columns[1:]):
                own = held.setdefault(b, [None, [], []])
                if got[0].is_valid:
                    own[0] = got[0].as_py()
                for k in (1, 2):
                    if got[k].is_valid:
                        own[k].append(got[k].as_py())
        for b in sorted(held):
            yield from rows(*held.pop(b))

    return returned.repartition("batch").mapInArrow(releasing(run), _INDEX)


def index_of(rows: DataFrame, extract: Extract, t: float) -> DataFrame:
    """Steps 1 to 3, written to the shared folder."""
    buckets = 2 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(indexed(counted(incidence(rows, extract, buckets), buckets), t))


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """Column arrays of the stream cut so that rows equal in the first ``keys`` columns stay together."""
    kept: list[list[np.ndarray]] = []

    def joined() -> list[np.ndarray]:
        return kept[0] if len(kept) == 1 else [np.concatenate(x) for x in zip(*kept)]

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        change = np.zeros(batch.num_rows - 1, bool)
        for c in cols[:keys]:
            change |= c[1:] != c[:-1]
        if kept and any(kept[-1][k][-1] != cols[k][0] for k in range(keys)):
            yield joined()
            kept = []
        at = np.flatnonzero(change)
        if len(at):
            last = int(at[-1]) + 1
            kept.append([c[:last] for c in cols])
            yield joined()
            kept = [[c[last:] for c in cols]]
        else:
            kept.append(cols)
    if kept:
        yield joined()


def pairs_in(left: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places ``(i, j)``, ``left[i]`` of them for each ``i``: ``i + 1`` and on, in steps of bounded size."""
    total = np.concatenate([[0], np.cumsum(left)])
    lo = 0
    while lo < len(left):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + _STEP, side="right")) - 1)
        i = np.repeat(np.arange(lo, hi), left[lo:hi])
        yield i, i + 1 + np.arange(len(i)) - np.repeat(total[lo:hi] - total[lo], left[lo:hi])
        lo = hi


def meetings(h: np.ndarray, k: np.ndarray, size: np.ndarray, place: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
    """A forest ``(root, node)`` of the sets that meet in whole columns, given by hash and then by size."""
    start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    each = np.diff(np.append(start, len(h)))
    size, place = size.astype(np.int64), place.astype(np.int64)
    left = np.repeat(start + each, each) - np.arange(len(h)) - 1
    chain = np.repeat(each > _CHAIN, each)
    i = np.flatnonzero(chain & (left > 0))
    i = i[size[i] >= t * size[i + 1] - 1e-9]
    a, b = [k[i]], [k[i + 1]]
    held = 0
    for i, j in pairs_in(np.where(chain, 0, left)):
        room = np.minimum(size[i] - place[i], size[j] - place[j])
        ok = (size[i] >= t * size[j] - 1e-9) & (room >= (size[i] + size[j]) * (t / (1 + t)) - 1e-9)
        a.append(k[i[ok]])
        b.append(k[j[ok]])
        held += len(a[-1])
        if held > _STEP:
            root, node = forest(np.concatenate(a), np.concatenate(b))
            a, b, held = [root], [node], 0
    return forest(np.concatenate(a), np.concatenate(b))


def components_of(index: DataFrame, t: float) -> DataFrame:
    """``(id, comp)``: step 4 over the rows of ``index``, for all sets that meet another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, held = [], [], 0

        def out() -> pa.RecordBatch:
            root, node = forest(np.concatenate(a), np.concatenate(b))
            return pa.RecordBatch.from_arrays([pa.array(root), pa.array(node)], ["a", "b"])

        for columns in runs(batches, 1):
            root, node = meetings(*columns, t)
            a.append(root)
            b.append(node)
            held += len(root)
            if held > _STEP:
                yield out()
                a, b, held = [], [], 0
        if held:
            yield out()

    posts = index.filter("prefix > 0").select("k", "size", "alone", F.posexplode(F.slice("sig", F.lit(1), F.col("prefix"))).alias("i", "h"))
    posts = posts.select("h", "k", "size", (F.col("alone") + F.col("i")).alias("place")).repartition("h").sortWithinPartitions("h", "size", "k")
    return components(posts.mapInArrow(releasing(run), "a long, b long"))


def placed(index: DataFrame, comp: DataFrame, weights: DataFrame, block: int) -> DataFrame:
    """``(comp, i, j, block, k, size, lead, w, sig)``: each set in all the block products of its component.

    A component of up to ``block`` sets is one product; a larger one is dealt into blocks by hash, and each two
    blocks are a product.
    """
    blocks = comp.groupBy("comp").agg(F.ceil(F.count("*") / block).cast("int").alias("n"))
    large = broadcast_small(cut(blocks.filter("n > 1")))
    own = comp.select(F.col("id").alias("k"), "comp").join(weights, "k").join(large, "comp", "left").select("k", "comp", "lead", "w", F.coalesce("n", F.lit(1)).alias("n"))
    own = own.withColumn("block", F.pmod(F.xxhash64("k"), F.col("n")).cast("int"))
    rows = index.filter("prefix > 0").select("k", "size", "sig").join(broadcast_small(cut(own)), "k")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return rows.select("comp", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "k", "size", "lead", "w", "sig")


def overlaps(x: np.ndarray, y: np.ndarray, sets: list[np.ndarray], size: np.ndarray, t: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of the rows ``x`` with the rows ``y`` that reach Jaccard ``t``, and their overlap, in strips of ``x``.

    The sparse product of both blocks: columns that a 32nd of ``y`` or more holds are multiplied as dense strips, the
    others by their lists of rows. A row is never paired with itself; with ``x`` the same as ``y`` each pair comes
    from both its ends.
    """
    lens = np.array([len(s) for s in sets], np.int64)
    local = np.full(len(sets), -1, np.int64)
    local[y] = np.arange(len(y))
    value = np.concatenate([sets[r] for r in y])
    row = np.repeat(np.arange(len(y)), lens[y])
    order = np.argsort(value, kind="stable")
    value, row = value[order], row[order]
    start = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
    names, n = value[start], np.diff(np.append(start, len(value)))
    dense = np.flatnonzero(n * 32 >= max(64, len(y)))
    rank = np.full(len(names), -1, np.int64)
    rank[dense] = np.arange(len(dense))
    wide = np.repeat(rank >= 0, n)
    dense_row, dense_rank = row[wide], np.repeat(rank, n)[wide]
    step = max(1, 2 * _STEP // len(y))
    width = min(max(64, 4 * _STEP // max(len(y), min(step, len(x)))), max(1, len(dense)))
    sy = size[y].astype(np.float64)
    for lo in range(0, len(x), step):
        part = x[lo : lo + step]
        v = np.concatenate([sets[r] for r in part])
        r = np.repeat(np.arange(len(part)), lens[part])
        at = np.minimum(np.searchsorted(names, v), len(names) - 1)
        hit = names[at] == v
        at, r = at[hit], r[hit]
        acc = np.zeros((len(part), len(y)), np.float32)
        d = rank[at] >= 0
        for first in range(0, len(dense), width):  # strips of frequent columns
            lo_y, hi_y = np.searchsorted(dense_rank, (first, first + width))
            my = np.zeros((len(y), width), np.float32)
            my[dense_row[lo_y:hi_y], dense_rank[lo_y:hi_y] - first] = 1
            of = d & (rank[at] >= first) & (rank[at] < first + width)
            mx = np.zeros((len(part), width), np.float32)
            mx[r[of], rank[at[of]] - first] = 1
            acc += mx @ my.T
        at, r = at[~d], r[~d]
        flat = acc.ravel()
        total = np.concatenate([[0], np.cumsum(n[at])])
        a = 0
        while a < len(at):
            b = max(a + 1, int(np.searchsorted(total, total[a] + _STEP, side="right")) - 1)
            cnt = n[at[a:b]]
            place = np.repeat(start[at[a:b]], cnt) + np.arange(int(cnt.sum())) - np.repeat(total[a:b] - total[a], cnt)
            np.add.at(flat, np.repeat(r[a:b], cnt) * len(y) + row[place], np.float32(1))
            a = b
        same = local[part]
        own = np.flatnonzero(same >= 0)
        acc[own, same[own]] = -1
        ok = acc >= (size[part].astype(np.float64)[:, None] + sy) * (t / (1 + t)) - 1e-6
        i, j = np.nonzero(ok)
        yield part[i], y[j], acc[i, j].astype(np.int64)


def products(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
    """The two blocks of every product, as places of its rows, and the columns from ``k`` on."""
    for comp, bi, bj, block, *cols in runs(batches, 3):
        change = np.concatenate([[True], (comp[1:] != comp[:-1]) | (bi[1:] != bi[:-1]) | (bj[1:] != bj[:-1])])
        start = np.flatnonzero(change).tolist()
        for lo, hi in zip(start, [*start[1:], len(comp)]):
            own = block[lo:hi]
            yield np.flatnonzero(own == bi[lo]), np.flatnonzero(own == bj[lo]), [c[lo:hi] for c in cols]


def by_product(rows: DataFrame) -> DataFrame:
    return rows.repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j")


def linked(rows: DataFrame, t: float) -> DataFrame:
    """``(k, up, links)`` out of the rows of :func:`placed`: in each product the documents that a set is similar to,
    counted with their copies, and a set that it is connected with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, y, (k, size, _, w, sig) in products(batches):
            if not len(x) or not len(y):
                continue
            sets = [np.asarray(s, np.int64).view(np.uint64) for s in sig]
            links = np.zeros(len(k), np.int64)
            a, b = [], []
            for p, q, _ in overlaps(x, y, sets, size, t):
                np.add.at(links, p, w[q])
                if len(x) != len(y) or x[0] != y[0]:
                    np.add.at(links, q, w[p])
                root, node = forest(k[p], k[q])
                a.append(root)
                b.append(node)
            root, node = forest(np.concatenate(a), np.concatenate(b))
            at = np.argsort(k)
            up = k.copy()
            up[at[np.searchsorted(k[at], node)]] = root
            some = links > 0
            if some.any():
                yield pa.RecordBatch.from_arrays([pa.array(k[some]), pa.array(up[some]), pa.array(links[some])], ["k", "up", "links"])

    return by_product(rows).mapInArrow(releasing(run), "k long, up long, links long")


def classes(index: DataFrame, t: float, block: int) -> DataFrame:
    """``(id, ref, k, rows, comp, class_id, links)`` for every distinct ``(id, ref, k)`` of ``index``, with its number of rows.

    ``comp`` names all that chains of similar sets connect, ``class_id`` is the lowest id there (a null id comes
    last), ``links`` how many other ``(id, ref)`` have an equal or similar set.
    """
    docs = cut(index.groupBy("id", "ref", "k").agg(F.count("*").alias("rows")))
    sets = cut(docs.groupBy("k").agg(F.min("id").alias("lead"), F.count("*").alias("w")))
    met = cut(linked(placed(index, components_of(index, t), sets, block), t))
    return docs.join(with_classes(sets, met), "k").select("id", "ref", "k", "rows", "comp", "class_id", "links")


def with_classes(sets: DataFrame, met: DataFrame) -> DataFrame:
    """``(k, comp, class_id, links)`` for all of ``sets (k, lead, w)``; links are those of ``met (k, up, links)`` and the copies."""
    found = met.groupBy("k").agg(F.sum("links").alias("links"))
    comp = components(met.select(F.col("k").alias("a"), F.col("up").alias("b"))).select(F.col("id").alias("k"), "comp")
    found = cut(found.join(comp, "k").join(sets.select("k", "lead"), "k"))
    least = found.groupBy("comp").agg(F.min("lead").alias("least"))
    found = broadcast_small(cut(found.select("k", "comp", "links").join(least, "comp")))
    alone = F.col("comp").isNull()
    both = sets.join(found, "k", "left").withColumn("class_id", F.when(alone, F.col("lead")).otherwise(F.col("least")))
    return both.select("k", F.coalesce("comp", "k").alias("comp"), "class_id", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).cast("long").alias("links"))
