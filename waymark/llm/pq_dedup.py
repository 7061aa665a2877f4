"""Embedding near-duplicates by product quantisation.

Vectors are put into coarse inverted lists; each keeps its residual as subspace codes and the length of the error that the
codes leave. A query probes every list that can hold a vector near enough, compares itself with the codes there by table
lookups, and takes the exact cosine of those that the lookup cannot rule out. Two bounds make the search whole:

* q lies in the list i of its nearest centroid and y in list j, so the plane midway between c_i and c_j separates them. If they
  are t apart, one of them is at most t/2 from that plane. So a vector probes j if |q-c_j|^2 - |q-c_i|^2 <= 2 |c_i-c_j| t/2, and
  of each pair within t at least one side finds the other; a pair that only one side finds counts for both.
* the looked-up distance is off by at most the length of y's own coding error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import connected_components, cut

#: Vectors that the index is fitted on at most (expected), codes a subspace, and subspaces.
SAMPLE, CODES, SUBSPACES = 20_000, 256, 8
#: Members and queries of one tile at most (expected); tiles are compared in blocks.
TILE, BLOCK = 2048, 256
LIST_ROWS, MOST_LISTS = 64, 4096
SLACK = 1e-6


@dataclass
class Index:
    """Coarse centroids (lists, dims) and residual code books (SUBSPACES, CODES, dims / SUBSPACES), in dims padded to a multiple of SUBSPACES."""

    centroids: np.ndarray
    books: np.ndarray
    dims: int

    def pad(self, x: np.ndarray) -> np.ndarray:
        width = self.centroids.shape[1]
        return np.pad(x, ((0, 0), (0, width - x.shape[1])))

    def coarse(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(0, (x * x).sum(1)[:, None] - 2 * x @ self.centroids.T + (self.centroids**2).sum(1)[None, :])

    def encode(self, residual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes (n, SUBSPACES) and the length of what they leave."""
        n, sub = len(residual), self.books.shape[2]
        codes, error = np.empty((n, len(self.books)), np.uint8), np.zeros(n)
        for m, book in enumerate(self.books):
            part = residual[:, m * sub : (m + 1) * sub]
            codes[:, m] = np.argmin((book**2).sum(1)[None, :] - 2 * part @ book.T, axis=1)
            error += ((part - book[codes[:, m]]) ** 2).sum(1)
        return codes, np.sqrt(error)

    def tables(self, residual: np.ndarray) -> np.ndarray:
        """Squared distances (n, SUBSPACES, CODES) of each residual's parts to all codes."""
        sub = self.books.shape[2]
        parts = residual.reshape(len(residual), len(self.books), sub)
        return np.maximum(0, (parts**2).sum(2)[:, :, None] - 2 * np.einsum("nms,mks->nmk", parts, self.books) + (self.books**2).sum(2)[None, :, :])


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        lengths = (centres**2).sum(1)[None, :]
        nearest = np.concatenate([np.argmin(lengths - 2 * x[at : at + 1024] @ centres.T, axis=1) for at in range(0, len(x), 1024)])
        counts = np.bincount(nearest, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, x)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(1, counts)[:, None], x[rng.choice(len(x), k)])
    return centres


def fit(sample: np.ndarray, rows: int) -> Index:
    """An index from a sample of unit vectors; lists grow with the rows of the largest label, about one for LIST_ROWS, MOST_LISTS at most."""
    dims = sample.shape[1]
    width = -(-dims // SUBSPACES) * SUBSPACES
    x = np.pad(sample, ((0, 0), (0, width - dims)))
    centroids = kmeans(x, int(np.clip(rows // LIST_ROWS, 1, min(MOST_LISTS, len(x)))))
    index = Index(centroids, np.zeros((SUBSPACES, 1, width // SUBSPACES)), dims)
    residual = np.concatenate([x[at : at + 1024] - centroids[np.argmin(index.coarse(x[at : at + 1024]), axis=1)] for at in range(0, len(x), 1024)])
    sub = width // SUBSPACES
    index.books = np.stack([kmeans(residual[:, m * sub : (m + 1) * sub], min(CODES, len(x)), 8) for m in range(SUBSPACES)])
    return index


def normalised(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in double precision, filled with zeros up to dims, and which rows can link: not null, no null or non-finite component, not zero."""
    lengths = np.array([0 if v is None else len(v) for v in column.to_pylist()]) if column.null_count or column.values.null_count else None
    if lengths is None:
        offsets = column.offsets.to_numpy()
        lengths = np.diff(offsets)
        flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        out = np.zeros((len(column), dims))
        if len(flat):
            row = np.repeat(np.arange(len(column)), lengths)
            out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
        good = lengths > 0
    else:
        out, good = np.zeros((len(column), dims)), np.zeros(len(column), bool)
        for k, v in enumerate(column.to_pylist()):
            if v and all(c is not None for c in v):
                out[k, : len(v)], good[k] = v, True
    good &= np.isfinite(out).all(1)
    out[~good] = 0
    most = np.abs(out).max(1, initial=0.0)
    good &= most > 0
    out /= np.where(most > 0, most, 1)[:, None]  # so that squares of huge or tiny components stay finite
    length = np.sqrt((out * out).sum(1))
    return out / np.where(length > 0, length, 1)[:, None], good


def probes(index: Index, x: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Own list of each vector, and pairs (row, list) of the lists whose border with its own is within radius."""
    d = index.coarse(x)
    own = np.argmin(d, axis=1)
    homes, at = np.unique(own, return_inverse=True)
    apart = np.sqrt(index.coarse(index.centroids[homes]))
    may = d - d[np.arange(len(x)), own][:, None] <= 2 * apart[at] * radius + SLACK
    may[np.arange(len(x)), own] = True
    row, lists = np.nonzero(may)
    return own, row, lists


def tile_links(index: Index, centroid: np.ndarray, queries: np.ndarray, members: np.ndarray, threshold: float) -> np.ndarray:
    """Boolean (queries, members): exact cosine at the threshold or over, looked at only where the codes leave room for it."""
    radius = np.sqrt(max(0.0, 2 - 2 * threshold))
    codes, error = index.encode(members - centroid)
    out = np.zeros((len(queries), len(members)), bool)
    for at in range(0, len(queries), BLOCK):
        block = queries[at : at + BLOCK]
        tables = index.tables(block - centroid)
        distance = np.zeros((len(block), len(members)))
        for m in range(len(index.books)):
            distance += tables[:, m, :][:, codes[:, m]]
        may = np.sqrt(distance) <= radius + error[None, :] + SLACK
        rows, columns = np.flatnonzero(may.any(1)), np.flatnonzero(may.any(0))
        if len(rows):
            exact = block[rows] @ members[columns].T >= threshold
            out[np.ix_(at + rows, columns)] = exact & may[np.ix_(rows, columns)]
    return out


def stars(link: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each query and member with a link, the first query of its component in the tile (else -1)."""
    q_root, m_root = np.full(link.shape[0], -1), np.full(link.shape[1], -1)
    open_q = link.any(1)
    while open_q.any():
        seed = int(np.argmax(open_q))
        frontier = np.array([seed])
        open_q[seed], q_root[seed] = False, seed
        while len(frontier):
            reached = np.flatnonzero(link[frontier].any(0) & (m_root < 0))
            m_root[reached] = seed
            frontier = np.flatnonzero(link[:, reached].any(1) & open_q) if len(reached) else np.empty(0, int)
            open_q[frontier], q_root[frontier] = False, seed
    return q_root, m_root


def near_duplicates(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.98) -> DataFrame:
    """(id_col, n_links, component_id, kept) for each row.

    Rows are compared if their labels are equal and not null and their vectors have the same length. Null and zero vectors and
    such with null or non-finite components link with nothing. Each row is a vector of its own, even if ids or vectors repeat.
    Equal vectors of a label always link; the search takes one of them with their number, so that copies cost no more than a join.
    n_links counts all rows at the threshold or over; links are counted inside tiles and never listed pair by pair, and only the
    edges that keep a tile's components together leave it. Raises ValueError for a threshold not in (0, 1].
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must lie in (0, 1]")
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v")).withColumn("uid", F.monotonically_increasing_id())
    # 128 bits stand for a label and vector; null where nothing can link.
    can = F.col("label").isNotNull() & (F.size("v") > 0)
    rows = cut(rows.withColumns({"k1": F.when(can, F.xxhash64("label", "v")), "k2": F.when(can, F.xxhash64(F.reverse("v"), "label"))}))
    equal = rows.where("k1 is not null").groupBy("k1", "k2").agg(F.min("uid").alias("first_uid"), F.count("*").alias("copies"))
    base = rows.join(equal, ["k1", "k2"], "left").select("id", "uid", "first_uid", "copies", F.when(F.col("uid") == F.col("first_uid"), F.col("label")).alias("label"), F.when(F.col("uid") == F.col("first_uid"), F.col("v")).alias("v"))
    base = cut(base)
    usable = base.where("uid = first_uid")
    n, dims, largest = usable.groupBy("label").agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dims")).agg(F.sum("n"), F.max("dims"), F.max("n")).first()
    if not n:
        return base.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept"))
    chosen = usable.where(F.pmod(F.xxhash64("uid"), F.lit(1 << 30)) < F.lit(SAMPLE / n * (1 << 30))).orderBy("uid").select("v").toArrow()
    column = chosen["v"].combine_chunks() if chosen.num_rows else pa.array([], pa.list_(pa.float64()))
    sample, good = normalised(column, dims) if len(column) else (np.zeros((0, dims)), np.zeros(0, bool))
    shared = spark.sparkContext.broadcast(fit(sample[good] if good.any() else np.eye(1, dims), largest))
    radius = float(np.sqrt(max(0.0, 2 - 2 * threshold)))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                lengths = np.array([len(v) for v in part.column("v").to_pylist()])
                unit, good = normalised(part.column("v"), dims)
                at_good = np.flatnonzero(good)
                if not len(at_good):
                    continue
                own, row, lists = probes(index, index.pad(unit[at_good]), radius / 2)
                row_all = at_good[np.r_[np.arange(len(at_good)), row]]
                lists_all = np.r_[own, lists]
                member = np.r_[np.ones(len(at_good), bool), np.zeros(len(row), bool)]
                # A member carries the lists that it probes itself, a query its own list.
                ends = np.searchsorted(row, np.arange(len(at_good) + 1))
                ends = np.r_[ends, ends[-1] + 1 + np.arange(len(row))].astype(np.int32)
                others = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.r_[lists, own[row]].astype(np.int32)))
                yield pa.record_batch([
                    part.column("label").take(pa.array(row_all)),
                    pa.array(lengths[row_all].astype(np.int32)),
                    pa.array(lists_all.astype(np.int32)),
                    pa.array(member),
                    part.column("uid").take(pa.array(row_all)),
                    part.column("copies").take(pa.array(row_all)),
                    others,
                    pa.array([x.tobytes() for x in unit[row_all]], pa.binary()),
                ], names=["label", "length", "list", "member", "uid", "copies", "others", "x"])

    routed = usable.select("label", "v", "uid", "copies").mapInArrow(route, "label string, length int, list int, member boolean, uid long, copies long, others array<int>, x binary")
    group = ["label", "length", "list"]
    counts = cut(routed.groupBy(*group).agg(F.ceil(F.count_if("member") / TILE).cast("int").alias("m_chunks"), F.ceil(F.count_if(~F.col("member")) / TILE).cast("int").alias("q_chunks")).where("m_chunks > 0"))
    spread = routed.join(counts, group)
    mine = F.pmod(F.xxhash64("uid"), F.when(F.col("member"), F.col("m_chunks")).otherwise(F.col("q_chunks"))).cast("int")
    others = F.sequence(F.lit(0), F.greatest(F.lit(1), F.when(F.col("member"), F.col("q_chunks")).otherwise(F.col("m_chunks"))) - 1)
    spread = spread.withColumn("mine", mine).withColumn("other", F.explode(others))
    tiles = spread.select(*group, "member", "uid", "copies", "others", "x", F.when(F.col("member"), F.col("mine")).otherwise(F.col("other")).alias("mc"), F.when(F.col("member"), F.col("other")).otherwise(F.col("mine")).alias("qc"))

    def compare(table: pa.Table) -> pa.Table:
        index = shared.value
        member = table["member"].to_numpy()
        x = index.pad(np.frombuffer(b"".join(table["x"].to_pylist()), np.float64).reshape(-1, dims))
        uid, copies = table["uid"].to_numpy(), table["copies"].to_numpy()
        q, m = uid[~member], uid[member]
        link = tile_links(index, index.centroids[table["list"][0].as_py()], x[~member], x[member], threshold)
        # A vector finds itself once, as a query in its own list; that stands for its copies.
        itself = q[:, None] == m[None, :]
        link = np.where(itself, copies[member][None, :] > 1, link)
        q_root, m_root = stars(link)
        keep_q, keep_m = np.flatnonzero(q_root >= 0), np.flatnonzero(m_root >= 0)
        others = table["others"].to_pylist()
        q_at, m_at = np.flatnonzero(~member)[keep_q].tolist(), np.flatnonzero(member)[keep_m].tolist()
        own = np.array([others[k][0] for k in q_at], int)
        probed = np.zeros((len(keep_m), len(index.centroids)), bool)
        for k, at in enumerate(m_at):
            probed[k, others[at]] = True
        # Where the member probes the query's list too, it counts the link there; else here.
        found = link[np.ix_(keep_q, keep_m)]
        n_q = found @ copies[member][keep_m] - (found & itself[np.ix_(keep_q, keep_m)]).sum(1)
        n_m = copies[~member][keep_q] @ (found & ~probed[:, own].T)
        return pa.table({"uid": np.r_[q[keep_q], m[keep_m]], "root": np.r_[q[q_root[keep_q]], q[m_root[keep_m]]], "n": np.r_[n_q, n_m].astype(np.int64)})

    found = cut(tiles.groupBy(*group, "mc", "qc").applyInArrow(compare, "uid long, root long, n long"))
    links = found.groupBy("uid").agg(F.sum("n").alias("n_links"))
    roots = connected_components(found.select(F.col("uid").alias("u"), F.col("root").alias("v")))
    # Links and roots by vector; equal rows that cannot link, such as zeros, have none and stay apart.
    known = links.join(roots.withColumnRenamed("node", "uid"), "uid", "left").select(F.col("uid").alias("first_uid"), "n_links", F.coalesce("root", "uid").alias("root"))
    joined = cut(base.select("id", "uid", "first_uid").join(known, "first_uid", "left").withColumn("root", F.coalesce("root", "uid")))
    least = joined.groupBy("root").agg(F.min("id").alias("component_id"))
    out = joined.join(least, "root")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
