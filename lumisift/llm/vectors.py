"""Usable vectors, classes of identical vectors and a hash-prefix forest.

A vector is usable if it has exactly ``dim`` finite numbers, not all zero; null,
empty, short, long and non-finite vectors are left out of every result. Identical
vectors (same bytes) form one class that takes part in the forest once, under its
smallest id, so that a third of all rows being copies costs nothing in the search.

Each tree is a sorted array of hash strings. It is cut at prefixes of varying length into
buckets, which are tasks, and each bucket, at longer prefixes, into leaves. A vector descends
to the leaf of its longest prefix and ascends in all trees alike: from its leaf towards the
bucket's prefix, over the leaves that lie nearest to it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import cut

SCALE = 1_000_000  # similarities travel as whole millionths: cosine rounded to 6 digits


@dataclass(frozen=True)
class Forest:
    """``trees`` sorted arrays of hash strings of ``letters`` letters each.

    A letter names the nearest of the 2 * ``axes`` signed axes of a random rotation. ``bucket``
    vectors are searched by one task; a leaf has at most ``leaf``; ``ascent`` leaves are visited besides
    the own one. Where a range is too large and its string is used up (a dense cone of vectors), the string goes on with
    the letters of the difference from the range's mean, so that no bucket or leaf grows with the density. Bucket
    borders come from a sample of about ``sample`` vectors, more if there are many buckets, two million at most.
    ``trees_per_pass`` bounds the vectors that are in shuffle files at once.
    """

    dim: int = 64
    trees: int = 9
    letters: int = 10
    axes: int = 32
    bucket: int = 65_536
    leaf: int = 512
    ascent: int = 6
    trees_per_pass: int = 3
    sample: int = 8192
    seed: int = 20

    def sized(self, n: int) -> Forest:
        """The forest for ``n`` vectors: more trees once two letters are needed to tell the buckets apart.

        A near pair shares a letter with a probability that is about the number of letters to the power -1/4,
        so the trees grow with that root of the number of buckets, and recall stays as it is.
        """
        return replace(self, trees=math.ceil(self.trees * max(1.0, n / self.bucket / (2 * min(self.axes, self.dim))) ** 0.25))


def usable(df: DataFrame, id_col: str, vec_col: str, dim: int = 64) -> DataFrame:
    """(id, vec) with vec as little-endian float32 bytes; one row per id with a usable vector."""

    def pack(batches):
        for b in batches:
            col, ids = b.column(1), b.column(0)
            lists = pa.array(col) if not isinstance(col, pa.Array) else col
            n = np.diff(lists.offsets.to_numpy(zero_copy_only=False))
            n = np.where(np.asarray(lists.is_valid()), n, -1)
            rows = np.flatnonzero((n == dim) & np.asarray(ids.is_valid()))
            if not len(rows):
                continue
            x = lists.take(pa.array(rows)).flatten().cast(pa.float32())
            x = x.fill_null(float("nan")).to_numpy(zero_copy_only=False).reshape(-1, dim)
            ok = np.isfinite(x).all(1) & (x != 0).any(1)
            x, rows = np.ascontiguousarray(x[ok] + np.float32(0)), rows[ok]  # + 0 makes -0.0 and 0.0 one
            vec = pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(np.arange(0, (len(x) + 1) * dim * 4, dim * 4, dtype=np.int32).tobytes()), pa.py_buffer(x.astype("<f4").tobytes())])
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), vec], names=["id", "vec"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<float>").alias("vec"))
    packed = rows.mapInArrow(pack, "id long, vec binary")
    return packed.groupBy("id").agg(F.min("vec").alias("vec"))


def classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Representatives (id, vec) of distinct vectors, members (id, cid) of classes of two or more, and the number of ids."""
    table = cut(vectors.withColumn("h", F.unhex(F.md5("vec"))), "vectors")
    multi = table.groupBy("h").agg(F.min("id").alias("cid"), F.count("*").alias("n")).filter("n > 1")
    members = cut(table.select("id", "h").join(multi.select("h", "cid"), "h").select("id", "cid"), "members")
    reps = table.select("id", "vec").join(members.filter("id <> cid").select("id"), "id", "left_anti")
    return reps, members, table.count()


def unpack(col, dim: int) -> np.ndarray:
    """A binary Arrow column as a float32 matrix."""
    buf = col.buffers()
    at = np.frombuffer(buf[1], dtype=np.int32, count=len(col) + 1 + col.offset)[col.offset]
    return np.frombuffer(buf[2], dtype="<f4", offset=int(at), count=len(col) * dim).reshape(-1, dim)


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return (x / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None]).astype(np.float32)


def _rotations(f: Forest, tree: int, level: int) -> np.ndarray:
    rng = np.random.default_rng([f.seed, tree, level])
    return np.hstack([np.linalg.qr(rng.standard_normal((f.dim, f.dim)))[0][:, : f.axes] for _ in range(f.letters)]).astype(np.float32)


def encode(u: np.ndarray, f: Forest, rot: np.ndarray) -> np.ndarray:
    """Each vector's string as one number, first letter in the highest bits."""
    d, bits = min(f.axes, f.dim), (2 * f.axes - 1).bit_length()
    out = np.zeros(len(u), dtype=np.int64)
    for lo in range(0, len(u), 4096):
        p = (u[lo : lo + 4096] @ rot).reshape(-1, f.letters, d)
        k = np.abs(p).argmax(2)
        word = 2 * k + (np.take_along_axis(p, k[:, :, None], 2)[:, :, 0] > 0)
        for s in range(f.letters):
            out[lo : lo + 4096] = out[lo : lo + 4096] << bits | word[:, s]
    return out


def _ranges(code: np.ndarray, lo: int, hi: int, depth: int, f: Forest, limit: float) -> Iterator[tuple[int, int]]:
    """Ranges of the sorted strings: the largest prefix subtrees within the limit, small siblings together."""
    if hi - lo <= limit or depth == f.letters:
        yield lo, hi
        return
    bits = (2 * f.axes - 1).bit_length()
    cuts = [lo, *(lo + 1 + np.flatnonzero(np.diff(code[lo:hi] >> bits * (f.letters - 1 - depth)))).tolist(), hi]
    at = lo
    for nxt, after in zip(cuts[1:], [*cuts[2:], None]):
        if after is None or nxt - at >= limit / 2 or after - at > limit:
            yield from _ranges(code, at, nxt, depth + 1, f, limit)
            at = nxt


@dataclass
class Trie:
    """Borders in the sorted strings of a tree; ``deeper`` holds (mean, trie of the differences) of ranges whose strings are used up."""

    f: Forest
    tree: int
    level: int
    starts: np.ndarray
    first: np.ndarray
    deeper: dict = field(default_factory=dict)

    def route(self, u: np.ndarray, code: np.ndarray | None = None, rot: dict | None = None) -> np.ndarray:
        """The number of every vector's range."""
        rot = {} if rot is None else rot
        if code is None:
            if self.level not in rot:
                rot[self.level] = _rotations(self.f, self.tree, self.level)
            code = encode(u, self.f, rot[self.level])
        at = np.searchsorted(self.starts, code, "right") - 1
        out = self.first[at]
        for k, (mean, trie) in self.deeper.items():
            rows = np.flatnonzero(at == k)
            if len(rows):
                out[rows] = self.first[k] + trie.route(unit(u[rows] - mean), None, rot)
        return out


def grow(u: np.ndarray, f: Forest, tree: int, limit: float, code: np.ndarray | None = None, level: int = 0, deepest: int = 8) -> tuple[Trie, np.ndarray, int]:
    """(trie, label, number of labels): ranges of at most ``limit`` of the given unit vectors.

    Vectors that eight levels of differences from the mean cannot tell apart are cut apart in the order given.
    """
    code = encode(u, f, _rotations(f, tree, level)) if code is None else code
    order = np.argsort(code, kind="stable")
    label, starts, first, deeper, n = np.zeros(len(u), dtype=np.int64), [], [], {}, 0
    for lo, hi in _ranges(code[order], 0, len(u), 0, f, limit):
        rows = order[lo:hi]
        starts.append(code[rows[0]] if len(rows) else 0)
        first.append(n)
        label[rows] = n
        if hi - lo > limit and level < deepest:
            mean = u[rows].mean(0)
            trie, sub, m = grow(unit(u[rows] - mean), f, tree, limit, None, level + 1, deepest)
            deeper[len(starts) - 1] = (mean, trie)
        else:
            m = max(1, int(-(-(hi - lo) // max(limit, 1))))
            sub = np.arange(hi - lo) * m // max(hi - lo, 1)
        label[rows] += sub
        n += m
    starts[0] = 0
    return Trie(f, tree, level, np.array(starts, dtype=np.int64), np.array(first, dtype=np.int64), deeper), label, n


def borders(reps: DataFrame, f: Forest, n: int) -> list[Trie]:
    """The bucket borders of every tree, from a sample that a hash of the id chooses; ``n`` is about the number of vectors."""
    want = min(max(f.sample, 20 * n // f.bucket), 2_000_000)
    rows = reps if n <= want else reps.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 40)) < int(want / n * (1 << 40)))
    got = rows.select("vec").toArrow()
    u = unit(np.frombuffer(b"".join(got.column("vec").to_pylist()), dtype="<f4").reshape(-1, f.dim))
    limit = max(f.bucket * len(u) / max(n, len(u), 1), 1.0)
    return [grow(u, f, t, limit)[0] for t in range(f.trees)]


def scattered(reps: DataFrame, f: Forest, tries: list[Trie], block: int = 32_768, piece: int = 4096) -> DataFrame:
    """(tree, bucket, ids, codes, vecs): the vectors of each bucket of the given trees, many to a row.

    A row packs what one task has for one bucket, so the shuffle moves few large rows.
    """

    def pack(ids, x):
        u = unit(x)
        for trie in tries:
            code = encode(u, f, rots[trie.tree][0])
            to = trie.route(u, code, rots[trie.tree])
            order = np.argsort(to, kind="stable")
            cuts = np.flatnonzero(np.diff(to[order])) + 1
            rows = [p[a : a + piece] for p in np.split(order, cuts) for a in range(0, len(p), piece)]
            yield pa.RecordBatch.from_pydict(
                {"tree": pa.array([trie.tree] * len(rows), pa.int32()), "bucket": pa.array([int(to[r[0]]) for r in rows], pa.int64()),
                 "ids": pa.array([ids[r].tobytes() for r in rows], pa.binary()), "codes": pa.array([code[r].tobytes() for r in rows], pa.binary()), "vecs": pa.array([x[r].tobytes() for r in rows], pa.binary())})

    rots = {}

    def run(batches):
        for trie in tries:
            rots[trie.tree] = {0: _rotations(f, trie.tree, 0)}
        held, n = [], 0
        for b in batches:
            if b.num_rows:
                held.append((b.column("id").to_numpy(zero_copy_only=False), unpack(b.column("vec"), f.dim)))
                n += b.num_rows
            if n >= block:
                yield from pack(*(np.concatenate(c) for c in zip(*held)))
                held, n = [], 0
        if held:
            yield from pack(*(np.concatenate(c) for c in zip(*held)))

    return reps.select("id", "vec").mapInArrow(run, "tree int, bucket long, ids binary, codes binary, vecs binary")


class Bucket:
    """The vectors of one bucket: ``ids``, unit vectors ``u`` in single precision, and exact cosines."""

    def __init__(self, f: Forest, tree: int, ids: np.ndarray, codes: np.ndarray, x: np.ndarray):
        order = np.argsort(ids)  # the same leaves, whatever the order of arrival
        self.f, self.tree, self.ids, self.codes, self.x = f, tree, ids[order], codes[order], x[order]
        self.u, self.norm = unit(self.x), np.linalg.norm(self.x.astype(np.float64), axis=1)

    def exact(self, r: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Cosines in double, as whole millionths."""
        out = np.empty(len(r), dtype=np.int32)
        for lo in range(0, len(r), 65536):
            a, b = r[lo : lo + 65536], c[lo : lo + 65536]
            dots = np.einsum("ij,ij->i", self.x[a].astype(np.float64), self.x[b].astype(np.float64))
            out[lo : lo + 65536] = np.rint(dots / self.norm[a] / self.norm[b] * SCALE)
        return out

    def meetings(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(visitors, members) of every leaf: the vectors whose ascent reaches it, its members among them, and its members."""
        _, leaf, n = grow(self.u, self.f, self.tree, self.f.leaf, self.codes)
        order = np.argsort(leaf, kind="stable")
        ends = np.searchsorted(leaf[order], np.arange(n + 1))
        reach = min(self.f.ascent + 1, n)
        if reach == n:
            everyone = np.arange(len(leaf))
            for k in range(n):
                yield everyone, order[ends[k] : ends[k + 1]]
            return
        mid = unit(np.add.reduceat(self.u[order], ends[:-1], axis=0, dtype=np.float64))
        visit = np.empty((len(leaf), reach), dtype=np.int32)
        for lo in range(0, len(leaf), 4096):
            s = self.u[lo : lo + 4096] @ mid.T
            s[np.arange(len(s)), leaf[lo : lo + 4096]] = 2.0  # the own leaf first
            visit[lo : lo + 4096] = np.argpartition(-s, reach - 1, axis=1)[:, :reach]
        flat = visit.reshape(-1)
        by = np.argsort(flat, kind="stable")
        stops = np.searchsorted(flat[by], np.arange(n + 1))
        for k in range(n):
            yield by[stops[k] : stops[k + 1]] // reach, order[ends[k] : ends[k + 1]]


def forest_map(reps: DataFrame, f: Forest, tries: list[Trie], kernel, schema: str) -> DataFrame:
    """``kernel(bucket)`` over every bucket of the given trees; it yields tuples of columns."""
    names = [p.split()[0] for p in schema.split(",")]
    types = [{"long": pa.int64(), "int": pa.int32()}[p.split()[1]] for p in schema.split(",")]

    def run(t: pa.Table) -> pa.Table:
        ids, codes, x = (np.frombuffer(b"".join(t.column(c).to_pylist()), dtype=d) for c, d in (("ids", np.int64), ("codes", np.int64), ("vecs", "<f4")))
        b = Bucket(f, t.column("tree")[0].as_py(), ids, codes, x.reshape(-1, f.dim))
        found = [c for c in kernel(b)] or [tuple(np.empty(0, dtype=np.int64) for _ in names)]
        return pa.table([pa.array(np.concatenate(c), k) for c, k in zip(zip(*found), types)], names=names)

    return scattered(reps, f, tries).groupBy("tree", "bucket").applyInArrow(run, schema)


def passes(f: Forest, tries: list[Trie]) -> Iterator[list[Trie]]:
    for t in range(0, len(tries), f.trees_per_pass):
        yield tries[t : t + f.trees_per_pass]


def best_of(df: DataFrame, by: str, k: int) -> DataFrame:
    """The first k rows per ``by`` in (sim descending, other ascending)."""
    w = Window.partitionBy(by).orderBy(F.col("sim").desc(), F.col("other"))
    return df.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k).drop("rn")
