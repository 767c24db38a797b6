"""Near-duplicate vectors by lattice hashing.

Each table projects unit vectors onto random orthonormal directions, eight for each of LATTICES E8
lattices, and decodes to the nearest lattice points; together they are the home cell. A vector also
probes the PROBES neighbouring cells that lie closest. Two vectors meet where one's home is the
other's home or probe.

A projection of a unit vector has a spread of one over the root of the dimension, so the lattice is scaled
by SCALE over that root (over that of all directions, where the dimension is smaller). Then with two
lattices, three probes and six tables pairs of cosine 0.90 and 0.93 meet in some table with probability
0.95 and 0.99 in any dimension from 8 on, and unrelated ones with 0.001 to 0.004 (0.011 in 8 dimensions,
where they are often near). The hash has no fitted part; every row is indexed.

Those that meet are compared twice. First by SKETCH signs of random projections, which travel with the
cells: a row of a cell is 49 bytes, whatever the dimension. At the threshold 37 of 256 signs differ, give
or take 6, and pairs with 66 or fewer pass, which one of ten million at 0.9 misses and few below 0.6 do.
Only vectors with such a partner are dealt out again, with all components, for cosines in double precision.

Vectors that are null, zero, or hold null or non-finite components link with nothing: they have no
links and are their own component. Vectors of different lengths don't link; each length is indexed apart,
whatever else its batch holds. Equal vectors are one node in the search, and the copies count as
links; rows that share an id but not the vector, and rows without an id, are searched like others. The
component of vectors without any id is null, and rows without an id aren't kept. An empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomseq.llm.buckets import linked
from loomseq.llm.common import components, map_batches, materialise

THRESHOLD, TABLES, LATTICES, PROBES, SCALE, SEED = 0.9, 6, 2, 3, 2.4, 8
SKETCH, DIFFER = 256, 66
_SIGNS = [f"s{k}" for k in range(SKETCH // 64)]


def minimal_vectors() -> np.ndarray:
    """The 240 shortest E8 vectors: two entries of +-1, or all +-1/2 with an even number of minus signs."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1, -1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


NEIGHBOURS = minimal_vectors()


def _even(x: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum: round, and mend the worst coordinate if the sum is odd."""
    f = np.rint(x)
    off = x - f
    worst = np.abs(off).argmax(-1)[..., None]
    step = np.where(np.take_along_axis(off, worst, -1) >= 0, 1.0, -1.0)
    odd = (f.sum(-1) % 2 != 0)[..., None]
    moved = np.take_along_axis(f, worst, -1) + np.where(odd, step, 0.0)
    np.put_along_axis(f, worst, moved, -1)
    return f


def nearest(x: np.ndarray) -> np.ndarray:
    """Nearest E8 points: the better of the even integers and those shifted by one half."""
    a, b = _even(x), _even(x - 0.5) + 0.5
    closer = ((x - a) ** 2).sum(-1) <= ((x - b) ** 2).sum(-1)
    return np.where(closer[..., None], a, b)


class Tables:
    """Projections for vectors of one dimension; the same on every executor."""

    def __init__(self, dim: int, tables: int = TABLES, lattices: int = LATTICES, probes: int = PROBES, scale: float = SCALE):
        r = np.random.default_rng(SEED)
        k = lattices * 8
        self.turn = [np.linalg.qr(r.normal(size=(max(dim, k), k)))[0][:dim] for _ in range(tables)]
        self.shift = r.uniform(0, 1, size=(tables, k))
        self.mix = r.integers(1, 1 << 62, size=(tables, k), dtype=np.int64) | 1
        self.lattices, self.probes, self.scale = lattices, probes, scale / np.sqrt(max(dim, k))
        self.signs = r.normal(size=(dim, SKETCH))

    def cells(self, unit: np.ndarray) -> np.ndarray:
        """(rows, tables, 1 + probes) cell numbers, the home cell first. Cells are hashed to 64 bits;
        a clash only adds a candidate."""
        out = []
        for t, turn in enumerate(self.turn):
            y = (unit @ turn / self.scale + self.shift[t]).reshape(len(unit), self.lattices, 8)
            home = nearest(y)
            gain = (y - home) @ NEIGHBOURS.T  # the larger, the closer the neighbouring point
            flat = gain.reshape(len(unit), -1)
            best = np.argpartition(-flat, self.probes, axis=1)[:, : self.probes]
            mix = self.mix[t].reshape(self.lattices, 8)
            twice = np.rint(2 * home).astype(np.int64)
            code = (twice * mix).sum((1, 2))
            lattice, which = np.divmod(best, len(NEIGHBOURS))
            moves = np.rint(2 * NEIGHBOURS).astype(np.int64)[which]
            near = code[:, None] + (moves * mix[lattice]).sum(-1)
            out.append(np.concatenate([code[:, None], near], axis=1) ^ (np.int64(t + 1) << np.int64(56)))
        return np.stack(out, axis=1)


    def sketch(self, unit: np.ndarray) -> np.ndarray:
        """(rows, SKETCH / 64) signs of random projections."""
        return np.packbits(unit @ self.signs > 0, axis=1).view(np.int64)


_made: dict[int, Tables] = {}


def tables_of(dim: int) -> Tables:
    if dim not in _made:
        _made[dim] = Tables(dim)
    return _made[dim]


def _matrices(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length, unit vectors in double precision and the positions of their rows; unusable rows
    are left out."""
    size = np.asarray(pc.fill_null(pc.list_value_length(column), 0), dtype=np.int64)  # flatten() skips null lists
    flat = pc.fill_null(column.flatten().cast(pa.float64(), safe=False), np.nan).to_numpy(zero_copy_only=False)
    start, out = np.cumsum(size) - size, []
    for dim in np.unique(size[size > 0]).tolist():
        good = np.nonzero(size == dim)[0]
        x = flat[start[good][:, None] + np.arange(dim)]
        top = np.abs(x).max(1)  # a null or NaN component makes it NaN
        fine = np.isfinite(top) & (top > 0)
        x, at = x[fine] / top[fine, None], good[fine]
        if len(at):
            out.append((x / np.sqrt((x * x).sum(1))[:, None], at))
    return out


def cell_rows(vectors: DataFrame) -> DataFrame:
    """(key, id, home, signs) from (id, vector): a row for the home cell and each probe of each table."""

    def run(b: pa.RecordBatch):
        for unit, at in _matrices(b.column("vector")):
            tables = tables_of(unit.shape[1])
            cells, signs = tables.cells(unit) ^ np.int64(unit.shape[1] << 32), tables.sketch(unit)  # lengths meet in no bucket
            ids = b.column("id").take(pa.array(at))
            for t in range(cells.shape[1]):
                for p in range(cells.shape[2]):
                    yield {"key": cells[:, t, p], "id": ids, "home": np.full(len(at), p == 0)} | dict(zip(_SIGNS, signs.T))

    return map_batches(vectors.select("id", "vector"), run, "key bigint, id bigint, home boolean" + "".join(f", {c} bigint" for c in _SIGNS), rows=1024)


def _load_sketch(b: pa.RecordBatch):
    signs = np.stack([np.asarray(b.column(c)) for c in _SIGNS], axis=1).view(np.uint64)
    return signs, b.column("home").to_numpy(zero_copy_only=False)


def _near_sketch(payload, ids, keys, i, j):
    signs, home = payload
    ok = home[i] | home[j]
    at = np.nonzero(ok)[0]
    ok[at] = np.bitwise_count(signs[i[at]] ^ signs[j[at]]).sum(1, dtype=np.int64) <= DIFFER
    return ok


def bucket_rows(vectors: DataFrame) -> DataFrame:
    """(key, id, weight, vector, home): the cells once more, with the whole vectors."""
    kind = vectors.schema["vector"].dataType.simpleString()

    def run(b: pa.RecordBatch):
        for unit, at in _matrices(b.column("vector")):
            cells = tables_of(unit.shape[1]).cells(unit) ^ np.int64(unit.shape[1] << 32)
            good = b.take(pa.array(at))
            for t in range(cells.shape[1]):
                for p in range(cells.shape[2]):
                    yield {"key": cells[:, t, p], "id": good.column("id"), "weight": good.column("weight"), "vector": good.column("vector"), "home": np.full(len(at), p == 0)}

    return map_batches(vectors.select("id", "vector", "weight"), run, f"key bigint, id bigint, weight bigint, vector {kind}, home boolean", rows=1024)


def checker(threshold: float = THRESHOLD):
    """The payload reader and the pair test for buckets.linked()."""

    def load(b: pa.RecordBatch):
        size = np.asarray(pc.list_value_length(b.column("vector")))
        place, units = np.zeros(len(size), np.int64), {}
        for unit, at in _matrices(b.column("vector")):  # a matrix for each length; cells are found when they are asked for
            units[unit.shape[1]] = unit, np.zeros((len(at), TABLES, 1 + PROBES), np.int64), np.zeros(len(at), bool)
            place[at] = np.arange(len(at))
        return (size, place, units), b.column("home").to_numpy(zero_copy_only=False)

    def verify(payload, ids, keys, i, j):
        """True in the first bucket that a pair shares, if its cosine reaches the threshold."""
        (size, place, units), home = payload
        ok = np.zeros(len(i), bool)
        fits = (home[i] | home[j]) & (size[i] == size[j])
        for dim, (v, cells, known) in units.items():
            own = np.nonzero(fits & (size[i] == dim))[0]
            for c in range(0, len(own), 1 << 14):
                k = own[c : c + (1 << 14)]
                a, b = place[i[k]], place[j[k]]
                near = np.einsum("ij,ij->i", v[a], v[b]) >= threshold
                k, a, b = k[near], a[near], b[near]
                new = np.unique(np.concatenate([a, b]))
                new = new[~known[new]]
                if len(new):
                    cells[new], known[new] = tables_of(dim).cells(v[new]) ^ np.int64(dim << 32), True
                open_ = np.ones(len(k), bool)
                for t in range(cells.shape[1]):  # the first table where they meet, there the first cell
                    x, y = cells[a, t], cells[b, t]
                    ab, ba = (x[:, :1] == y).any(1), (y[:, :1] == x).any(1)
                    here = np.where(ab & ba, np.minimum(x[:, 0], y[:, 0]), np.where(ab, x[:, 0], y[:, 0]))
                    ok[k[open_ & (ab | ba) & (here == keys[i[k]])]] = True
                    open_ &= ~(ab | ba)
        return ok

    return load, verify


def classes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """(id_col, n_links, component_id, kept), one row for each row of the table."""
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("vector"))
    # Equal vectors are one node, named by a hash; a second one makes sure. -0.0 and 0.0 are the same number.
    number = F.transform("vector", lambda x: x.cast("double") + F.lit(0.0))
    usable = F.coalesce(F.exists("vector", lambda x: x != 0) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))
    hashed = rows.withColumn("usable", usable).withColumns({
        "id": F.when(F.col("usable"), F.xxhash64(F.size("vector"), number)), "same": F.when(F.col("usable"), F.xxhash64(number, F.lit(1))),
    })
    marked = materialise(hashed.select("vec_id", "id", "same"))
    nodes = materialise(
        marked.where("id is not null").groupBy("id", "same").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    )
    one = hashed.where("usable").select("id", "vector").dropDuplicates(["id"])
    wide = linked(cell_rows(one), _load_sketch, _near_sketch).select("id").distinct()
    wanted = materialise(nodes.join(wide, "id").select("id", F.col("copies").alias("weight")))
    live = materialise(hashed.where("usable").select("id", "vector").join(wanted, "id").dropDuplicates(["id"]))
    load, verify = checker(threshold)
    found = materialise(linked(bucket_rows(live), load, verify))
    partners = found.groupBy("id").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    known = nodes.join(partners, "id", "left").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    least = known.groupBy("root").agg(F.min("least").alias("component_id"))
    named = materialise(
        known.join(least, "root").select("id", "same", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    )
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return marked.join(named, ["id", "same"], "left").select(
        F.col("vec_id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
