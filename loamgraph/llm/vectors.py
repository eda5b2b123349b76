"""Similar vectors without comparing all of them: cells around centroids, and tiles in which the members of a cell meet.

Centroids are fitted on a bounded sample; every vector is placed. Where there are more vectors than the sample has centroids
for, each cell is cut again by centroids of the residuals, which all cells share, so that the number of cells grows with the
data while what is fitted stays bounded. A vector belongs to the cell of its closest centroid
and visits the cells whose centroid is closer than that less a margin. Two vectors meet in the cell of either that the
other visits, so a pair is missed only if neither visits the other's. A cell with many rows is cut into tiles
that other tasks take, so no row is dropped and no task holds a whole crowded cell.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from loamgraph.runtime import broadcast_if, cut, parallelism, tidy

#: Vectors in the sample on which centroids and codebooks are fitted, about; at most twice as many are read.
SAMPLE = 16_384
#: Vectors that a cell holds on average.
CELL = 1_500
#: How much less close than the closest centroid a visited one may be.
MARGIN = 0.15
#: Rows on either side of a tile, about; on the left WIDE times as many where there are cells enough for all tasks, as each
#: tile of a cell gets its members anew.
TILE = 8_192
WIDE = 4
#: Centroids of the sample make cells of up to so many times the wanted size before these are cut by finer ones, whose cells are
#: visited by far more vectors (67 instead of 22 on average, where four finer ones cut 2,048).
COARSE = 4
#: Rows of tiles that lie on disk at once, as a multiple of the placed rows, and at least. Cells beyond that wait for another pass.
PASS = 2
PASS_ROWS = 1_000_000
#: Rows of a tile that are compared at once.
BLOCK = 512


def vector_rows(df: DataFrame, id_col: str, vector_col: str, dim: int, kind: str | None = None) -> DataFrame:
    """``(kind, id, vec)`` of the rows that may hold a valid vector; :func:`place` leaves out the others.

    Valid are ``dim`` finite numbers, not all zero. Ids are compared without letter case; a null id is no record.
    """
    return df.where(F.col(id_col).isNotNull() & (F.size(vector_col) == dim)).select(
        F.lit(kind).cast("string").alias("kind"), F.lower(F.col(id_col)).alias("id"), F.col(vector_col).cast("array<float>").alias("vec")
    )


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """A list column as a float32 matrix; null elements become NaN."""
    c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return c.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(-1, dim)


def unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows scaled to length 1 in float64, and which of them are valid."""
    y = x.astype(np.float64)
    with np.errstate(over="ignore", invalid="ignore"):
        n = np.sqrt(np.einsum("ij,ij->i", y, y))
        ok = np.isfinite(n) & (n > 0)
        y /= np.where(ok, n, 1)[:, None]
    return y, ok


def sample_units(rows: DataFrame, dim: int, size: int = SAMPLE) -> tuple[np.ndarray, int]:
    """Unit vectors of a sample by hash of the id, in order of id, and the number of rows."""
    n = rows.count()
    share = min(1.0, size / max(n, 1))
    some = rows.where(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) + 1)).select("id", "vec").limit(2 * size)
    got = some.toArrow().sort_by("id")
    if got.num_rows == 0:
        return np.empty((0, dim)), n
    y, ok = unit(matrix(got["vec"], dim))
    return y[ok], n


def centroids(sample: np.ndarray, cells: int, rounds: int = 8) -> np.ndarray:
    """Unit centroids by spherical k-means, at most one for eight vectors; one without vectors starts anew at one that is far from its own."""
    dim = sample.shape[1]
    if len(sample) == 0:
        return np.eye(1, dim, dtype=np.float32)
    x = sample.astype(np.float32)
    cells = max(1, min(cells, len(x) // 8 or 1))
    c = x[np.random.default_rng(0).choice(len(x), cells, replace=False)].copy()
    for _ in range(rounds):
        s = x @ c.T
        own = s.argmax(1)
        total = np.zeros((cells, dim))
        np.add.at(total, own, x)
        n = np.linalg.norm(total, axis=1)
        empty = n < 1e-9
        total[~empty] /= n[~empty, None]
        if empty.any():
            far = np.argsort(s[np.arange(len(x)), own], kind="stable")[: empty.sum()]
            total[empty] = x[far]
        c = total.astype(np.float32)
    return c


@dataclass
class Codes:
    """Four-bit codes of the residual to the centroid, one a subspace, fitted with a score-aware loss.

    The loss of a residual error e at a unit vector x is ``|e|^2 + (eta - 1) (x.e)^2``: errors parallel to x, which
    change high inner products, weigh ``eta`` times as much. eta follows from the least similarity that counts.
    """

    books: np.ndarray  # subspaces x 16 x width
    eta: float
    error: float = 0.0  # of estimated against true similarity, at least this large for few pairs in a thousand

    @property
    def subspaces(self) -> int:
        return len(self.books)

    def encode(self, x: np.ndarray, r: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Codes (rows x subspaces, uint8) of residuals r at unit vectors x, by coordinate descent on the loss."""
        s, _, w = self.books.shape
        xs, rs = x.reshape(len(x), s, w), r.reshape(len(r), s, w)
        codes = np.empty((len(x), s), dtype=np.uint8)
        along = np.empty((len(x), s), dtype=np.float32)  # x.e of each subspace
        square, dot = [], []
        for j in range(s):
            b = self.books[j]
            square.append(np.maximum((rs[:, j] ** 2).sum(1)[:, None] - 2 * rs[:, j] @ b.T + (b**2).sum(1), 0))
            dot.append((xs[:, j] * rs[:, j]).sum(1)[:, None] - xs[:, j] @ b.T)
            codes[:, j] = square[j].argmin(1)
            along[:, j] = np.take_along_axis(dot[j], codes[:, j : j + 1].astype(np.int64), 1)[:, 0]
        for _ in range(sweeps):
            for j in range(s):
                rest = along.sum(1) - along[:, j]
                codes[:, j] = (square[j] + (self.eta - 1) * (rest[:, None] + dot[j]) ** 2).argmin(1)
                along[:, j] = np.take_along_axis(dot[j], codes[:, j : j + 1].astype(np.int64), 1)[:, 0]
        return codes

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([self.books[j][codes[:, j]] for j in range(self.subspaces)], axis=1)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Inner products of queries with all centres, two subspaces a table of 256: rows x (subspaces / 2) x 256."""
        s, k, w = self.books.shape
        one = np.einsum("nsw,skw->nsk", q.reshape(len(q), s, w), self.books).astype(np.float32)
        return (one[:, 0::2, :, None] + one[:, 1::2, None, :]).reshape(len(q), s // 2, k * k)

    def scan(self, tables: np.ndarray, pairs: np.ndarray) -> np.ndarray:
        """Estimated inner products of queries with residuals: one look-up a pair of codes."""
        out = tables[:, 0].take(pairs[:, 0], axis=1)
        for j in range(1, tables.shape[1]):
            out += tables[:, j].take(pairs[:, j], axis=1)
        return out

    @staticmethod
    def packed(codes: np.ndarray) -> np.ndarray:
        """Two four-bit codes in a byte."""
        return (codes[:, 0::2] << 4 | codes[:, 1::2]).astype(np.uint8)


def fit_codes(sample: np.ndarray, centres: np.ndarray, threshold: float, width: int = 4, rounds: int = 5, own: np.ndarray | None = None) -> Codes:
    """Codebooks that minimise the score-aware loss over a sample of unit vectors; own: the centre of each one's cell, if not the closest."""
    x = sample.astype(np.float32)
    dim = x.shape[1] if len(x) else centres.shape[1]
    if dim % (2 * width):
        width = next(w for w in (2, 1) if dim % (2 * w) == 0) if dim % 2 == 0 else dim
    s = dim // width
    eta = max(1.0, (dim - 1) * threshold**2 / max(1e-9, 1 - threshold**2))
    rng = np.random.default_rng(1)
    if len(x) < 32:
        return Codes(rng.normal(0, 0.1, (s, 16, width)).astype(np.float32), eta, 1.0)
    own = centres[(x @ centres.T).argmax(1)] if own is None else own.astype(np.float32)
    r = x - own
    rs, xs = r.reshape(-1, s, width), x.reshape(-1, s, width)
    code = Codes(np.stack([rs[rng.choice(len(x), 16, replace=len(x) < 16), j] for j in range(s)]).astype(np.float32), eta)
    for _ in range(rounds):
        got = code.encode(x, r)
        e = (r - code.decode(got)).reshape(-1, s, width)
        for j in range(s):
            along = np.einsum("nsw,nsw->n", xs, e) - (xs[:, j] * e[:, j]).sum(1)
            # least squares of each centre under the loss, the other subspaces as they are
            outer = np.einsum("ni,nj->nij", xs[:, j], xs[:, j]) * (eta - 1) + np.eye(width, dtype=np.float32)
            right = rs[:, j] + (eta - 1) * xs[:, j] * (along + (xs[:, j] * rs[:, j]).sum(1))[:, None]
            a, b = np.zeros((16, width, width)), np.zeros((16, width))
            np.add.at(a, got[:, j], outer)
            np.add.at(b, got[:, j], right)
            held = np.bincount(got[:, j], minlength=16) > 0
            code.books[j][held] = np.linalg.solve(a[held] + 1e-6 * np.eye(width), b[held][:, :, None])[:, :, 0]
            e[:, j] = rs[:, j] - code.books[j][got[:, j]]
    got = code.decode(code.encode(x, r)) + own
    near = []
    for i in range(0, len(x), 1024):
        true = x[i : i + 1024] @ x.T
        at = np.nonzero(true >= threshold)
        near.append(np.abs((x[i : i + 1024][at[0]] * got[at[1]]).sum(1) - true[at])[at[0] + i != at[1]])
    near = np.concatenate(near)
    code.error = float(np.quantile(near, 0.998)) + 0.01 if len(near) >= 100 else 0.25
    return code


@dataclass
class Index:
    """What is fitted: centroids, the finer ones by which each cell is cut where there are any, and codes where asked for.

    Cell ``c * k + j`` of k finer centroids has the direction of centroid c plus finer centroid j.
    """

    dim: int
    centres: np.ndarray
    margin: float = MARGIN
    codes: Codes | None = None
    finer: np.ndarray | None = None

    def centre(self, cells: np.ndarray) -> np.ndarray:
        """Unit centres of cells."""
        if self.finer is None:
            return self.centres[cells]
        k = len(self.finer)
        c = self.centres[cells // k] + self.finer[cells % k]
        return c / np.maximum(np.linalg.norm(c, axis=-1, keepdims=True), 1e-9)

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The cell of each unit vector; and rows and cells of the others that it visits, in order of the row."""
        s = x @ self.centres.T
        seen = s >= (s.max(1) - self.margin)[:, None]
        if self.finer is None:
            own = s.argmax(1)
            seen[np.arange(len(x)), own] = False
            return own, *np.nonzero(seen)
        k, fine = len(self.finer), x @ self.finer.T
        cross = self.centres @ self.finer.T
        norm = np.sqrt(np.maximum(1 + 2 * cross + (self.finer**2).sum(1), 1e-9))
        own, who, where = np.empty(len(x), dtype=np.int64), [], []
        for i in range(len(x)):
            c = np.flatnonzero(seen[i])
            t = (s[i, c, None] + fine[i]) / norm[c]
            best = int(t.argmax())
            own[i] = c[best // k] * k + best % k
            a, b = np.nonzero(t >= t.flat[best] - self.margin)
            near = c[a] * k + b
            near = near[near != own[i]]
            who.append(np.full(len(near), i))
            where.append(near)
        none = np.empty(0, dtype=np.int64)
        return own, np.concatenate([none, *who]), np.concatenate([none, *where])


def fit(rows: DataFrame, dim: int, codes_for: float | None = None, cell: int = CELL, sample: int = SAMPLE, margin: float = MARGIN, coarse: int = 1) -> Index:
    """An index over ``rows (kind, id, vec)``; codes_for: the least similarity that the codes are made for; coarse: how many times the
    wanted size cells may have before finer centroids cut them."""
    x, n = sample_units(rows, dim, sample)
    wanted = -(-n // cell)
    index = Index(dim, centroids(x, wanted), margin)
    if wanted > coarse * len(index.centres) and len(x) >= 16:
        left = (x - index.centres[(x @ index.centres.T).argmax(1)]).astype(np.float32)
        index.finer = _plain_centroids(left, -(-wanted // len(index.centres)))
    if codes_for is not None:
        index.codes = fit_codes(x, index.centres, codes_for, own=index.centre(index.cells(x.astype(np.float32))[0]))
    return index


def _plain_centroids(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Means of x by k-means, at most one for eight rows."""
    k = max(1, min(k, len(x) // 8))
    c = x[np.random.default_rng(2).choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        own = ((c**2).sum(1) - 2 * x @ c.T).argmin(1)
        total, n = np.zeros(c.shape), np.bincount(own, minlength=k)
        np.add.at(total, own, x)
        c[n > 0] = (total[n > 0] / n[n > 0, None]).astype(np.float32)
    return c


PLACED = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("vec", T.ArrayType(T.FloatType())),
        T.StructField("cell", T.IntegerType()),
        T.StructField("visits", T.ArrayType(T.IntegerType())),
        T.StructField("code", T.BinaryType()),
    ]
)


def place(rows: DataFrame, index: Index, packed: bool = False) -> DataFrame:
    """Valid rows with their cell, the other cells they visit and their code; written to the shared folder.

    packed: the bytes of the vector in the place of the code, and one row an id, lying by kind and id.
    """
    held = rows.sparkSession.sparkContext.broadcast(index)  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = held.value
        for b in batches:
            raw = matrix(b.column(2), ix.dim)
            x, ok = unit(raw)
            x = x[ok].astype(np.float32)
            kept = b.filter(pa.array(ok))
            if kept.num_rows == 0:
                continue
            cell, who, where = ix.cells(x)
            visits = pa.ListArray.from_arrays(pa.array(np.searchsorted(who, np.arange(len(x) + 1)), pa.int32()), pa.array(where, pa.int32()))
            vec = kept.column(2)
            if packed:
                vec, code = pa.nulls(len(x), pa.list_(pa.float32())), pa.array([r.tobytes() for r in raw[ok].astype("<f4")], pa.binary())
            elif ix.codes is None:
                code = pa.nulls(len(x), pa.binary())
            else:
                code = pa.array([p.tobytes() for p in Codes.packed(ix.codes.encode(x, x - ix.centre(cell)))], pa.binary())
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), vec, pa.array(cell, pa.int32()), visits, code], names=PLACED.names)

    placed = rows.mapInArrow(run, PLACED)
    if packed:
        n = max(parallelism(rows.sparkSession), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        placed = placed.repartition(n, "kind", "id").dropDuplicates(["kind", "id"])
    return cut(placed)


def loads(placed: DataFrame, tile: int = TILE) -> tuple[DataFrame, int, int]:
    """``(kind, at, ni, nj, pass)``: by how many rows and columns of tiles each cell is cut, and in which pass it is worked on; the
    number of cells and of passes."""
    spark = placed.sparkSession
    both = placed.select("kind", F.explode(F.concat(F.array("cell"), "visits")).alias("at"), "cell")
    own = F.sum((F.col("at") == F.col("cell")).cast("long"))
    load = cut(both.groupBy("kind", "at").agg(F.count("*").alias("all"), own.alias("own")))
    n_cells = load.count()
    left = tile * (WIDE if n_cells >= 16 * parallelism(spark) else 1)
    cell = load.select("kind", "at", "all", "own", F.ceil(F.col("all") / left).cast("int").alias("ni"), F.greatest(F.ceil(F.col("own") / tile), F.lit(1)).cast("int").alias("nj"))
    n, rows = cell.agg(F.coalesce(F.sum("own"), F.lit(0)), F.coalesce(F.sum(F.col("all") * F.col("nj") + F.when(F.col("ni") * F.col("nj") > 1, F.col("own") * F.col("ni")).otherwise(0)), F.lit(0))).head()
    passes = max(1, -(-rows // max(PASS_ROWS, PASS * n)))
    return cell.select("kind", "at", "ni", "nj", F.pmod(F.xxhash64("kind", "at", F.lit(19)), F.lit(passes)).alias("pass")), n_cells, passes


def tiles(placed: DataFrame, load: DataFrame, n_cells: int) -> DataFrame:
    """Rows of every tile of the cells in ``load``: ``placed`` with ``at`` (a cell), ``i``, ``j`` and ``role``.

    A tile compares its left rows (role 1), which are members or visitors of the cell, with its right rows (role 2),
    members only; a member of a cell of one tile is both (role 3).
    """
    spark = placed.sparkSession
    n_tiles = load.agg(F.coalesce(F.sum(F.col("ni") * F.col("nj")), F.lit(1))).head()[0]
    spread = placed.withColumn("at", F.explode(F.concat(F.array("cell"), "visits"))).join(broadcast_if(load.drop("pass"), n_cells), ["kind", "at"])
    # only members are asked which cells they visit
    spread = spread.withColumn("visits", F.when(F.col("at") == F.col("cell"), F.col("visits")).otherwise(F.array().cast("array<int>")))
    part = lambda n: F.pmod(F.xxhash64("id", F.lit(3)), F.col(n).cast("long")).cast("int")
    member = F.col("at") == F.col("cell")
    left = F.transform(F.sequence(F.lit(0), F.col("nj") - 1), lambda j: F.struct(part("ni").alias("i"), j.alias("j"), F.lit(1).alias("role")))
    right = F.transform(F.sequence(F.lit(0), F.col("ni") - 1), lambda i: F.struct(i.alias("i"), part("nj").alias("j"), F.lit(2).alias("role")))
    once = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.when(member, 3).otherwise(1).alias("role")))
    seats = F.when((F.col("ni") == 1) & (F.col("nj") == 1), once).when(member, F.concat(left, right)).otherwise(left)
    out = spread.withColumn("seat", F.explode(seats)).select(*placed.columns, "at", "seat.i", "seat.j", "seat.role")
    # heavy in work, not in bytes: a number of partitions that is not lowered for small ones
    n = max(1, min(int(n_tiles), 16 * parallelism(spark)))
    return out.repartition(n, "kind", "at", "i", "j")


class Side:
    """One side of a tile: distinct records, in order of rank (a hash of the id, then the id)."""

    def __init__(self, t: pa.Table, index: Index, role: int):
        t = t.filter(pa.array((t["role"].to_numpy() & role) > 0))
        h = t["h"].to_numpy()
        ids = np.array(t["id"].to_pylist(), dtype=object)
        order = np.lexsort((ids.astype(str), h)) if len(ids) else np.empty(0, dtype=np.int64)
        if len(order):
            same = np.zeros(len(order), dtype=bool)
            same[1:] = ids[order][1:] == ids[order][:-1]
            order = order[~same]
        self.t = t.take(pa.array(order, pa.int64()))
        self.h, self.ids = h[order], ids[order]
        if self.t["vec"].null_count and self.t["vec"].null_count == len(self.t):
            raw = np.frombuffer(b"".join(self.t["code"].to_pylist()), dtype="<f4").reshape(-1, index.dim)
        else:
            raw = matrix(self.t["vec"], index.dim)
        self.x64, _ = unit(raw)
        self.x = self.x64.astype(np.float32)
        self.cell = self.t["cell"].to_numpy()

    def __len__(self) -> int:
        return len(self.ids)

    def visits(self, cells: np.ndarray) -> np.ndarray:
        """Whether each row visits each of the sorted cells."""
        lists = self.t["visits"].combine_chunks()
        flat, off = lists.flatten().to_numpy(), np.asarray(lists.offsets)
        who = np.repeat(np.arange(len(self)), np.diff(off))
        at = np.minimum(np.searchsorted(cells, flat), len(cells) - 1)
        ok = cells[at] == flat
        out = np.zeros((len(self), len(cells)), dtype=bool)
        out[who[ok], at[ok]] = True
        return out


class Tile:
    """Left and right rows of a tile, and who has to be told of a pair.

    The left row of a pair always is. The right row is told if the left one is a visitor whose own cell it
    does not visit; else it finds the pair there, or as a left row here.
    """

    def __init__(self, t: pa.Table, index: Index):
        self.left, self.right = Side(t, index, 1), Side(t, index, 2)
        self.at = t["at"][0].as_py()
        self.kind = t["kind"][0].as_py()
        where = {x: k for k, x in enumerate(self.right.ids)}
        self.self_at = np.array([where.get(x, -1) for x in self.left.ids], dtype=np.int64)
        self.visitor = self.left.cell != self.at
        homes = np.unique(self.left.cell[self.visitor])
        self.home = np.searchsorted(homes, self.left.cell)
        self.deaf = self.right.visits(homes) if len(homes) and len(self.right) else np.zeros((len(self.right), max(1, len(homes))), dtype=bool)

    def told(self, block: slice) -> np.ndarray:
        """Left rows of the block x right rows: whether the right row is told."""
        rows = self.visitor[block]
        out = np.zeros((len(rows), len(self.right)), dtype=bool)
        if rows.any():
            out[rows] = ~self.deaf[:, self.home[block][rows]].T
        return out

    def blocks(self) -> Iterator[slice]:
        if len(self.right):
            for a in range(0, len(self.left), BLOCK):
                yield slice(a, min(a + BLOCK, len(self.left)))

    def similar(self, block: slice, threshold: float) -> np.ndarray:
        """Which pairs of the block reach the threshold, other than a record with itself; exact at its edge."""
        s = self.left.x[block] @ self.right.x.T
        mask = s >= threshold
        edge = np.nonzero(np.abs(s - threshold) < 1e-5)
        if len(edge[0]):
            true = np.einsum("ij,ij->i", self.left.x64[block][edge[0]], self.right.x64[edge[1]])
            mask[edge] = true >= threshold
        own = self.self_at[block]
        mask[np.flatnonzero(own >= 0), own[own >= 0]] = False
        return mask


def over_tiles(placed: DataFrame, index: Index, work: Callable[[Tile], pa.Table], schema: T.StructType, tile: int = TILE) -> DataFrame:
    """``work`` over every tile of ``placed``, which has at least the columns of :func:`place` and ``h``.

    A vector lies in every cell that it visits, more the more cells there are, so cells are taken in passes of which each writes
    what it found before the next begins; the rows of one pass at a time are on disk. Every cell is in one pass.
    """
    spark = placed.sparkSession
    held = spark.sparkContext.broadcast(index)

    def run(t: pa.Table) -> pa.Table:
        return work(Tile(t, held.value))

    def over(load: DataFrame) -> DataFrame:
        return tiles(placed, load, n_cells).groupBy("kind", "at", "i", "j").applyInArrow(run, schema)

    load, n_cells, passes = loads(placed, tile)
    if passes == 1:
        return over(load)
    found = None
    for k in range(passes):
        got = cut(over(load.where(F.col("pass") == k)))
        found = got if found is None else found.unionByName(got)
        tidy(spark)
    return found


def with_rank(placed: DataFrame) -> DataFrame:
    return placed.withColumn("h", F.xxhash64("id", F.lit(11)))


def empty_placed(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], PLACED)


def recall(found: DataFrame, rows: DataFrame, k: int, threshold: float, dim: int, queries: int = 500) -> float:
    """Share of the true neighbours that ``found (kind, id, other)`` has, of about ``queries`` records chosen by a hash of the id.

    The truth is by brute force: the bounded queries are broadcast and compared with every row of their kind, a block at a time.
    1.0 where no query has a neighbour.
    """
    n = max(1, rows.count())
    asked = rows.where(F.pmod(F.xxhash64("id", F.lit(29)), F.lit(1 << 20)) < F.lit(int(min(1.0, queries / n) * (1 << 20)) + 1)).limit(4 * queries).toArrow()
    if asked.num_rows == 0:
        return 1.0
    q, ok = unit(matrix(asked["vec"], dim))
    kinds, ids = (np.array(asked[c].to_pylist(), dtype=object)[ok] for c in ("kind", "id"))
    q = q[ok]
    held = rows.sparkSession.sparkContext.broadcast((q, kinds, ids))
    schema = "kind string, id string, other string, cosine double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, kinds, ids = held.value
        for b in batches:
            x, ok = unit(matrix(b.column(2), dim))
            other, kind = np.array(b.column(1).to_pylist(), dtype=object), np.array(b.column(0).to_pylist(), dtype=object)
            s = np.round(q @ x.T, 6)
            i, j = np.nonzero((s >= threshold) & ok[None, :] & (kinds[:, None] == kind[None, :]) & (ids[:, None] != other[None, :]))
            yield pa.RecordBatch.from_arrays([pa.array(list(kinds[i]), pa.string()), pa.array(list(ids[i]), pa.string()), pa.array(list(other[j]), pa.string()), pa.array(s[i, j])], names=["kind", "id", "other", "cosine"])

    best = Window.partitionBy("kind", "id").orderBy(F.col("cosine").desc(), "other")
    true = rows.select("kind", "id", "vec").mapInArrow(run, schema).distinct().withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= k)
    got = true.join(found.select("kind", "id", "other", F.lit(1).alias("hit")), ["kind", "id", "other"], "left").agg(F.count("*"), F.count("hit")).head()
    return got[1] / got[0] if got[0] else 1.0
