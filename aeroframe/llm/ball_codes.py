"""Vector codes by product quantisation, the codebooks fitted with ball k-means on integer components.

Every part of a vector belongs to the ball of its entry; the ball's radius is the distance of its farthest part. When entries
have moved, only entries whose centre lies within twice a ball's radius can take parts from it: those are the ball's neighbours.
A part closer to its centre than half the way to the nearest neighbour is in the stable core and stays without any comparison;
beyond it, rings at half the distance of each neighbour tell how many of the neighbours a part has to be compared with. All
distances are integers, so the codes are those of a full search, ties included.

A round reads the vectors and their codes from a file, writes them with their new codes, and adds to the same rows what each
task counted: sums, counts and radius of each entry. Only those sums (entries x dimension) reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aeroframe.llm.text import stored

#: Squared distances stay below this, so that a distance and an entry's index share one 64-bit key, and its float64 form is exact.
MOST = 1 << 44

SUMS = ["part", "entry", "at", "total", "members", "far"]


class Balls:
    """Entries of one part position, and which of them can take parts from each ball."""

    def __init__(self, entries: np.ndarray, radius: np.ndarray | None):
        self.entries = entries
        if radius is not None:
            between = squared(entries, entries)
            self.order = np.argsort(between, axis=1, kind="stable")
            # an entry is in its own row at distance 0; it is compared like a neighbour, which costs nothing and keeps ties right
            self.gap = np.take_along_axis(between, self.order, axis=1)
            # 4 r^2 of a radius known from above, rounded up
            self.reach = np.array([np.searchsorted(g, r, side="right") for g, r in zip(self.gap, 4.0 * (radius * (1 + 1e-9) + 1e-6) ** 2, strict=True)])

    def full_search(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return nearest(parts, self.entries, np.arange(len(self.entries)))

    def move(self, parts: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """New codes and squared distances of parts whose codes before the entries moved are given."""
        new, far = code.astype(np.int64), squared_to(parts, self.entries[code])
        for ball in np.unique(code):
            mine = np.flatnonzero(code == ball)
            near, gap = self.order[ball][:self.reach[ball]], self.gap[ball][:self.reach[ball]]
            # neighbours that a part meets: those not farther from the centre than twice the part; more than itself is needed
            ring = np.searchsorted(gap, 4 * far[mine], side="right")
            alone = near[0] == ball and (len(gap) < 2 or gap[1] > 0)
            todo = ring > 1 if alone else ring > 0
            mine, ring = mine[todo], ring[todo]
            lo = 1 if alone else 0
            while lo < len(near) and len(mine):
                hi = min(len(near), max(8, 2 * lo))
                inside = (ring > lo) & (ring <= hi) if hi < len(near) else ring > lo
                if inside.any():
                    at = mine[inside]
                    new[at], far[at] = nearest(parts[at], self.entries[near[:hi]], near[:hi])
                lo = hi
        return new, far


def squared_to(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return np.einsum("ij,ij->i", d, d)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All squared distances of integer rows; float64 products are exact below MOST."""
    x, y = a.astype(np.float64), b.astype(np.float64)
    return ((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T)).astype(np.int64)


def nearest(parts: np.ndarray, entries: np.ndarray, index: np.ndarray, block: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of each part (ties: the smaller index) and its squared distance."""
    code, far = np.empty(len(parts), np.int64), np.empty(len(parts), np.int64)
    wide = int(index.max()) + 1
    for at in range(0, len(parts), block):
        key = (squared(parts[at:at + block], entries) * wide + index[None, :]).min(axis=1)
        code[at:at + block], far[at:at + block] = key % wide, key // wide
    return code, far


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """List column as int64 rows of length ``dim``; another length and components beyond the exact range are errors."""
    sizes = np.diff(column.offsets.to_numpy())
    if len(sizes) and (sizes != dim).any():
        raise ValueError(f"vectors of {sorted(set(sizes.tolist()) - {dim})[0]} components among vectors of {dim}")
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)
    check_range(x)
    return x


def check_range(x: np.ndarray) -> None:
    if x.size and 4 * x.shape[1] * max(int(x.max()), -int(x.min())) ** 2 >= MOST:
        raise ValueError("components are too large for exact distances")


def _assign(books: np.ndarray, radius: np.ndarray | None, sums: bool):
    """New state rows; with ``sums`` also rows of what this task's parts add to each entry."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        balls = [Balls(books[p], None if radius is None else radius[p]) for p in range(parts)]
        total, members, far_of = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64), np.full((parts, entries), -1, np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column("v"), parts * width)
            old = None if radius is None else np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint16).reshape(-1, parts)
            code, error = np.empty((len(x), parts), np.uint16), np.zeros(len(x), np.int64)
            for p in range(parts):
                own = np.ascontiguousarray(x[:, p * width:(p + 1) * width])
                c, far = balls[p].full_search(own) if old is None else balls[p].move(own, old[:, p])
                code[:, p] = c
                error += far
                if sums:
                    order = np.argsort(c, kind="stable")
                    used, first = np.unique(c[order], return_index=True)
                    total[p, used] += np.add.reduceat(own[order], first, axis=0)
                    members[p, used] += np.diff(np.append(first, len(c)))
                    far_of[p, used] = np.maximum(far_of[p, used], np.maximum.reduceat(far[order], first))
            raw = code.tobytes()
            codes = pa.array([raw[i:i + 2 * parts] for i in range(0, len(raw), 2 * parts)], pa.binary())
            none = [pa.nulls(len(x), t) for t in (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), b.column("v"), codes, pa.array(error), *none], ["vec_id", "label", "v", "code", "error", *SUMS])
        p, e = np.nonzero(members)
        if len(p):
            n = len(p) * width
            flat = [np.repeat(p, width).astype(np.int32), np.repeat(e, width).astype(np.int32), np.tile(np.arange(width), len(p)).astype(np.int32),
                    total[p, e].ravel(), np.repeat(members[p, e], width), np.repeat(far_of[p, e], width)]
            kinds = [b.schema.field(c).type for c in ("vec_id", "label", "v")]
            yield pa.RecordBatch.from_arrays([*(pa.nulls(n, t) for t in kinds), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64()), *map(pa.array, flat)], ["vec_id", "label", "v", "code", "error", *SUMS])
    return run


def round_of(rows: DataFrame, books: np.ndarray, radius: np.ndarray | None, name: str, sums: bool = True) -> tuple[DataFrame, DataFrame]:
    """The written state after an assignment, and the rows of sums in the same files."""
    head = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select("vec_id", "label", "v").schema)
    kind = f"{head}, code binary, error long, part int, entry int, at int, total long, members long, far long"
    out = stored(rows.mapInArrow(_assign(books, radius, sums), kind), name)
    return out.filter("part IS NULL").select("vec_id", "label", "v", "code", "error"), out.filter("part IS NOT NULL")


def fit(rows: DataFrame, books: np.ndarray, rounds: int) -> tuple[DataFrame, np.ndarray]:
    """State after the last assignment (code, error) and the final codebooks (part, entry, component)."""
    state, radius = rows, None
    for k in range(rounds):
        state, sums = round_of(state, books, radius, f"codes-round{k}")
        table = sums.groupBy("part", "entry", "at").agg(F.sum("total").alias("total"), F.sum("members").alias("members"), F.max("far").alias("far")).toPandas()
        p, e, at = (table[c].to_numpy() for c in ("part", "entry", "at"))
        new = books.copy()
        new[p, e, at] = np.floor_divide(table["total"].to_numpy(), table["members"].to_numpy())
        # a ball's parts lie within the old radius of the old centre: about the new one, that and the way the centre moved
        far = np.zeros(books.shape[:2])
        far[p, e] = np.sqrt(table["far"].to_numpy())
        radius = far + np.sqrt(((new - books).astype(np.float64) ** 2).sum(axis=2))
        books = new
    return round_of(state, books, radius, "codes-final", sums=False)[0], books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encode(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 4, entries: int = 256, rounds: int = 4,
           scale: int = 1024, most_labels: int = 200_000) -> DataFrame:
    """One row per kept row of ``vectors``: vec_id, code, error, label_error, codebooks_sha256.

    Rows whose vector is null, empty, or holds a null or non-finite component are dropped. A component x counts as floor(scale * x). The
    codebooks start from the vectors with the smallest ids (ties: by components; null ids last), fewer than ``entries`` if there are
    fewer; an entry without parts stays. Repeated rows are vectors of their own. ``code`` has two hex digits a part (four if entries
    exceed 256), ``label_error`` sums the errors of equal labels, null labels together. Vectors of different lengths, lengths that
    ``parts`` doesn't divide and components too large for exact 64-bit distances raise an error. No vectors give no rows. Other
    columns are ignored. Tables of more than ``most_labels`` labels are joined back by shuffles, smaller ones are broadcast."""
    if not 0 < entries <= 1 << 16:
        raise ValueError("entries must be between 1 and 65536")
    x = F.col(vector)
    whole = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    ints = F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long"))
    rows = vectors.filter(whole).select(F.col(key).alias("vec_id"), F.col(label).alias("label"), ints.alias("v"))
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    final = rows.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    if not first:
        return final.limit(0)
    dim = len(first[0].v)
    if dim % parts or any(len(r.v) != dim for r in first):
        raise ValueError(f"vectors of {dim} components can't be cut into {parts} equal parts, or lengths differ")
    start = np.array([r.v for r in first], np.int64)
    check_range(start)
    state, books = fit(rows, start.reshape(len(first), parts, dim // parts).transpose(1, 0, 2).copy(), rounds)
    digits = 2 if entries <= 256 else 4
    # codes are little-endian 16-bit numbers: the low byte comes first
    hexes = F.hex("code")
    number = lambda p: F.concat(*([F.substr(hexes, F.lit(4 * p + 3), F.lit(2))] if digits == 4 else []), F.substr(hexes, F.lit(4 * p + 1), F.lit(2)))
    coded = state.select("vec_id", "label", F.lower(F.concat(*[number(p) for p in range(parts)])).alias("code"), "error")
    sums = stored(coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "b_label"), "codes-labels")
    other = F.broadcast(sums) if sums.count() <= most_labels else sums
    return (coded.join(other, coded["label"].eqNullSafe(other["b_label"]))
            .select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256")))
