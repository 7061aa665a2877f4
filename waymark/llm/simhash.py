"""SimHash near-duplicates with pigeonring filtering.

Fingerprints come from XXH64 of word shingles. Two fingerprints that differ in at most `radius` of 64 bits, cut into m
segments on a ring, have a start from which every chain of l consecutive segments differs in at most l * radius / m bits.
With more segments than differing bits the start itself is equal in both, which gives the join keys: with radius + 1 segments a
key is one segment and its place. Candidates that share a key must then show a chain from an equal start that keeps within its
budgets at every length; most fail at the second segment, and only those that pass all lengths have had all their bits counted.
Keys of one segment select too little among very many fingerprints: m then grows and keys are the segments that the budgets of
chains force to be equal, which are as many sets as the plain pigeonhole principle has; the chains prune their candidates.

Fingerprints of texts whose shingle sets have a Jaccard similarity of 0.8 differ in about 10 bits, too many for such keys. keep_one
therefore also links by the sets themselves: MinHash bands give the candidates, and their exact similarity decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import column_bytes, connected_components, cut, document_batches, drop_cut, free_shuffles, slices

#: Shingles hashed at a time, and fingerprints that one task compares with each other at most.
SHINGLE_BLOCK, TILE = 1 << 15, 8192
#: Rows of keys that a task compares at a time, besides those of one key.
KEY_ROWS = 1 << 16
#: Runs of equal keys up to so long are compared side by side, longer ones breadth first.
SMALL_RUN = 256
#: Keys have as many bits as leave about so many fingerprints to a key if their bits are even, and so many bits at least.
FINGERPRINTS_A_KEY, LEAST_KEY_BITS = 64, 12
#: MinHash bands and values a band. A pair of similarity s shares no band with probability (1 - s^ROWS)^BANDS: 3e-6 at 0.8.
BANDS, ROWS = 32, 5
_XOR, _ODD = (np.random.default_rng(seed).integers(0, 1 << 32, (BANDS * ROWS, 1), np.uint32) | np.uint32(1) for seed in (1, 2))
#: Shingles of a text for which MinHash values are computed at a time.
MINHASH_BLOCK = 1 << 9
#: Shingles (expected) in one of the two chunks of documents that a task compares by their sets.
TILE_SHINGLES = 1 << 17


def fingerprint(text: bytes | None, shingle: int, seen: list[np.ndarray] | None = None) -> int:
    """64-bit SimHash of a text in UTF-8: A-Z lower-cased, words between ASCII white space, shingles with repeats. The shingles' hashes are added to `seen`."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    take = max(1, len(words) - shingle + 1)
    first, last = starts[:take].tolist(), ends[len(words) - take :].tolist()
    if len(words) < shingle:
        first, last = [0], [len(joined)]
    h64, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, take, SHINGLE_BLOCK):
        hashes = np.array([h64(joined[a:b], 42) for a, b in zip(first[at : at + SHINGLE_BLOCK], last[at : at + SHINGLE_BLOCK])], np.uint64)
        if seen is not None:
            seen.append(hashes)
        counts += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(counts * 2 > take, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, keys: list[str], text_col: str = "text", shingle: int = 4) -> DataFrame:
    """The key columns and fp, the fingerprint's bits as a signed long. Null and blank texts have 0."""
    document_batches(docs.sparkSession)
    typed = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__simhash_text"):
            found = np.array([fingerprint(t, shingle) for t in column_bytes(batch.column("__simhash_text"))], np.uint64).view(np.int64)
            yield pa.record_batch([*(batch.column(c) for c in keys), pa.array(found)], names=[*keys, "fp"])

    return docs.select(*keys, F.col(text_col).cast("string").alias("__simhash_text")).mapInArrow(run, f"{typed}, fp long")


def shingle_set(seen: list[np.ndarray]) -> np.ndarray:
    return np.unique(np.concatenate(seen)) if seen else np.empty(0, np.uint64)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """A key for each MinHash band of a set of shingle hashes; none for the empty set."""
    if not len(hashes):
        return np.empty(0, np.int64)
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint32).max, np.uint32)
    room = np.empty((BANDS * ROWS, min(MINHASH_BLOCK, len(short))), np.uint32)
    for at in range(0, len(short), MINHASH_BLOCK):
        block = short[at : at + MINHASH_BLOCK]
        made = room[:, : len(block)]
        np.bitwise_xor(block, _XOR, out=made)
        np.multiply(made, _ODD, out=made)
        np.minimum(least, made.min(axis=1), out=least)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        key = (key ^ least[k::ROWS]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def signatures(docs: DataFrame, keys: list[str], text_col: str, shingle: int) -> DataFrame:
    """The key columns, fp, and of the set of shingles: its hash (null if it is empty), its size and its band keys."""
    document_batches(docs.sparkSession)
    typed = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keys)

    def one(text: bytes | None) -> tuple[int, int | None, int, np.ndarray]:
        seen: list[np.ndarray] = []
        fp, hashes = fingerprint(text, shingle, seen), shingle_set(seen)
        return fp, xxhash.xxh64_intdigest(hashes.tobytes(), 42) if len(hashes) else None, len(hashes), band_keys(hashes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__simhash_text"):
            fp, whole, n, bands = zip(*(one(t) for t in column_bytes(batch.column("__simhash_text"))))
            signed = [None if h is None else h - (h >> 63 << 64) for h in whole]
            made = [pa.array(np.array(fp, np.uint64).view(np.int64)), pa.array(signed, pa.int64()), pa.array(n, pa.int32()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.record_batch([*(batch.column(c) for c in keys), *made], names=[*keys, "fp", "whole", "n", "bands"])

    return docs.select(*keys, F.col(text_col).cast("string").alias("__simhash_text")).mapInArrow(run, f"{typed}, fp long, whole long, n int, bands array<long>")


def shingle_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(whole, hashes): the sorted shingle hashes of each row (whole, __simhash_text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__simhash_text"):
            found = []
            for text in column_bytes(batch.column("__simhash_text")):
                seen: list[np.ndarray] = []
                fingerprint(text, shingle, seen)
                found.append(shingle_set(seen).view(np.int64))
            yield pa.record_batch([batch.column("whole"), pa.array(found, pa.list_(pa.int64()))], names=["whole", "hashes"])

    return texts.select("whole", "__simhash_text").mapInArrow(run, "whole long, hashes array<long>")


def segment_widths(m: int) -> list[int]:
    return [64 // m + (i < 64 % m) for i in range(m)]


def segments_for(radius: int, bits: int) -> int:
    """The fewest segments of which those that must be equal make keys of `bits` bits."""
    return next((m for m in range(radius + 1, 33) if (m - radius) * (64 // m) >= bits), 32)


def key_bits(fingerprints: int) -> int:
    """More fingerprints need keys that select better, so that candidates grow with them and not with their square."""
    return max(LEAST_KEY_BITS, int(np.ceil(np.log2(max(1, fingerprints) / FINGERPRINTS_A_KEY))))


def zero_patterns(m: int, radius: int) -> list[tuple[int, ...]]:
    """Sets of segments of which one must be wholly equal, by the ring's budgets.

    From a start s, a chain of l segments holds floor(l * radius / m) differing bits at most, so that many segments of it may
    differ; the others are equal. The smallest sets that hit every such placement are listed, over all starts.
    """
    needed = m - radius
    if needed < 1:
        raise ValueError("more segments than differing bits are needed")
    found = set()
    for rest in combinations(range(1, m), needed - 1):
        equal = (0, *rest)
        # Among the first l segments at least l - floor(l * radius / m) are equal; the j-th equal one lies so early at the latest.
        latest = [min(n - 1 for n in range(1, m + 1) if n - n * radius // m >= j + 1) for j in range(needed)]
        if all(e <= x for e, x in zip(equal, latest, strict=True)):
            found |= {tuple(sorted((s + e) % m for e in equal)) for s in range(m)}
    return sorted(found)


def ring_passes(x: np.ndarray, m: int, radius: int, starts: tuple[int, ...] | None = None) -> np.ndarray:
    """Whether differing bits x (uint64) have a start on the ring (among `starts`) from which every chain stays within its budget.

    Each longer chain is looked at only where the shorter ones passed. The longest has all segments, so what passes differs in
    `radius` bits at most.
    """
    widths = segment_widths(m)
    at = np.r_[0, np.cumsum(widths)].tolist()
    passes = np.zeros(len(x), bool)
    for start in range(m) if starts is None else starts:
        alive = np.flatnonzero(~passes)
        bits, total = x[alive], np.zeros(len(alive), np.int32)
        for length in range(1, m + 1):
            k = (start + length - 1) % m
            total = total + np.bitwise_count((bits >> np.uint64(at[k])) & np.uint64((1 << widths[k]) - 1))
            kept = np.flatnonzero(total <= length * radius // m)
            if len(kept) < len(alive):
                alive, bits, total = alive[kept], bits[kept], total[kept]
        passes[alive] = True
    return passes


def near(a: np.ndarray, b: np.ndarray, pattern: np.ndarray, patterns: list[tuple[int, ...]], m: int, radius: int) -> np.ndarray:
    """Places of the pairs that are within `radius`: of those that meet under a pattern, a chain starts at one of its segments."""
    x, passes = a ^ b, np.zeros(len(a), bool)
    for p in np.unique(pattern):
        own = np.flatnonzero(pattern == p)
        passes[own] = ring_passes(x[own], m, radius, patterns[p])
    return np.flatnonzero(passes)


def spanning_links(key: np.ndarray, pattern: np.ndarray, fp: np.ndarray, patterns: list[tuple[int, ...]], m: int, radius: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links that connect what pairs within `radius` connect, in runs of equal keys. Large runs are searched breadth first, so a dense group of n gives n - 1 links."""
    us, vs = [], []
    if not len(key):
        return us, vs
    bounds = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
    sizes = np.diff(bounds)
    small = np.repeat((sizes > 1) & (sizes <= SMALL_RUN), sizes)
    at, step = np.flatnonzero(small), 1
    while len(at):
        at = at[at + step < len(key)]
        at = at[key[at] == key[at + step]]
        hit = at[near(fp[at], fp[at + step], pattern[at], patterns, m, radius)]
        us.append(fp[hit])
        vs.append(fp[hit + step])
        step += 1
    for i in np.flatnonzero(sizes > SMALL_RUN):
        left, queue = np.unique(fp[bounds[i] : bounds[i + 1]]), []
        while len(left):
            if not queue:
                queue, left = [left[0]], left[1:]
            at_hand = queue.pop()
            hit = np.flatnonzero(ring_passes(left ^ at_hand, m, radius, patterns[pattern[bounds[i]]]))
            us.append(np.full(len(hit), at_hand))
            vs.append(left[hit])
            queue += list(left[hit])
            left = np.delete(left, hit)
    return us, vs


def _hot_keys(keys: DataFrame, rows: int) -> DataFrame | None:
    """(key, chunks) of keys with more than TILE fingerprints; None if there are none.

    Keys are counted in buckets first, which tasks combine before the shuffle; only keys of buckets over TILE are counted one by one.
    """
    buckets = 1 << int(np.clip(np.ceil(np.log2(max(1, rows) / 64)), 16, 26))
    bucket = F.pmod("key", F.lit(buckets))
    heavy = cut(keys.groupBy(bucket.alias("bucket")).count().where(F.col("count") > TILE).select("bucket"))
    if heavy.isEmpty():
        return None
    counted = keys.withColumn("bucket", bucket).join(heavy, "bucket", "left_semi").groupBy("key").count()
    hot = cut(counted.where(F.col("count") > TILE).select("key", F.ceil(F.col("count") / TILE).cast("int").alias("chunks")))
    return None if hot.isEmpty() else hot


def fingerprint_links(distinct: DataFrame, radius: int = 4, segments: int | None = None) -> DataFrame:
    """Links (u, v) between distinct fingerprints (column fp) whose components are those of all pairs within `radius` bits.

    A key with more than TILE fingerprints is cut into chunks, and each pair of chunks is a group of its own: no task holds
    more than two chunks, and every pair still meets.
    """
    n = distinct.count()
    m = segments or segments_for(radius, key_bits(n))
    at, parts = 0, []
    for w in segment_widths(m):
        parts.append((at, w))
        at += w

    def packed(pattern: tuple[int, ...]) -> Column:
        value, used = F.lit(0).cast("long"), 0
        for s in pattern:
            start, width = parts[s]
            value = value.bitwiseOR(F.shiftleft(F.shiftrightunsigned(F.col("fp"), start).bitwiseAND(F.lit((1 << width) - 1).cast("long")), used))
            used += width
        return value

    patterns = zero_patterns(m, radius)
    bits = F.posexplode(F.array(*[packed(p) for p in patterns])).alias("pattern", "bits")
    keys = distinct.select("fp", bits).select("fp", "pattern", F.xxhash64("pattern", "bits").alias("key"))
    hot = _hot_keys(keys, n * len(patterns))
    if hot is not None:
        chunks = keys.join(hot, "key", "left").withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
        others = F.when(F.col("chunks").isNull(), F.array(F.lit(-1))).otherwise(F.filter(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: c != F.col("mine")))
        tiled = chunks.withColumn("other", F.explode(others))
        pair = F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other"))
        keys = tiled.select("fp", "pattern", F.when(F.col("chunks").isNull(), F.col("key")).otherwise(pair).alias("key"))
    keys = keys.repartition(F.col("key")).sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def links(last: bool) -> pa.RecordBatch | None:
            """Links among the held rows; those of the last key stay, as they may go on, unless it is the end."""
            key, pattern, fp = (np.concatenate(x) for x in zip(*held))
            end = len(key) if last else int(np.searchsorted(key, key[-1]))
            held[:] = [(key[end:], pattern[end:], fp[end:])]
            us, vs = spanning_links(key[:end], pattern[:end], fp[:end], patterns, m, radius)
            if sum(map(len, us)):
                return pa.record_batch([pa.array(np.concatenate(x).view(np.int64)) for x in (us, vs)], names=["u", "v"])

        for batch in batches:
            key, pattern, fp = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "pattern", "fp"))
            held.append((key, pattern, fp.view(np.uint64)))
            if sum(len(k) for k, _, _ in held) >= KEY_ROWS and (found := links(False)):
                yield found
        if held and (found := links(True)):
            yield found

    return keys.mapInArrow(run, "u long, v long").distinct()


def components(fps: DataFrame, radius: int = 4) -> DataFrame:
    """(fp, root) for each distinct fingerprint of `fps`; fingerprints linked over others have the same root."""
    distinct = cut(fps.select("fp").distinct())
    roots = connected_components(fingerprint_links(distinct, radius))
    return distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """(id_col, fp, component_id): component_id is the smallest id reachable over fingerprints within `radius` bits.

    Equal fingerprints, those of blank and null texts (0) included, are one class before anything is compared, so copies cost
    one row each. Rows with a null id get a component like others; it is null only where no id of the component is set.
    """
    marked = cut(fingerprints(docs.select(F.col(id_col).alias("id"), text_col), ["id"], text_col, shingle))
    classes = cut(marked.groupBy("fp").agg(F.min("id").alias("least")).join(components(marked, radius), "fp"))
    least = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    by_class = cut(classes.join(least, "root").select("fp", "component_id"))
    return marked.join(by_class, "fp", "left").select(F.col("id").alias(id_col), "fp", "component_id")


def alike_in_tile(root: np.ndarray, chunk: np.ndarray, sets: list[np.ndarray], similarity: float) -> tuple[list[int], list[int]]:
    """Links between roots, enough to connect what pairs of at least `similarity` connect.

    With two chunks in the tile, documents of one are compared with those of the other, else all with each other; documents that
    are connected already are not compared.
    """
    us, vs = [], []
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    starts = np.cumsum(sizes) - sizes
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    names, label = np.unique(root, return_inverse=True)
    mark = np.zeros(int(codes.max()) + 1, np.int32)
    first = chunk == chunk.min()
    crossed = not first.all()
    for u in np.flatnonzero(first):
        others = (label != label[u]) & (np.minimum(sizes, sizes[u]) >= np.maximum(sizes, sizes[u]) * similarity - 1e-6)
        others &= ~first if crossed else np.arange(len(sets)) > u
        if not others.any():
            continue
        own = codes[starts[u] : starts[u] + sizes[u]]
        mark[own] = 1
        common = np.add.reduceat(mark[codes], starts)
        mark[own] = 0
        for v in np.flatnonzero(others & (common >= (sizes + sizes[u] - common) * similarity - 1e-6)):
            if label[v] != label[u]:
                us.append(int(names[label[u]]))
                vs.append(int(names[label[v]]))
                label[label == label[v]] = label[u]
    return us, vs


def similar_links(rows: DataFrame, similarity: float) -> DataFrame:
    """Links (u, v) between roots from rows (tile, chunk, root, hashes): a tile's rows are read together, one tile after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def found() -> pa.RecordBatch | None:
            sets = [h.values.to_numpy() for batch in held for h in batch.column("hashes")]
            us, vs = alike_in_tile(*(np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("root", "chunk")), sets, similarity)
            held.clear()
            return pa.record_batch([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"]) if us else None

        tile = None
        for batch in batches:
            tiles = batch.column("tile").to_numpy()
            bounds = np.flatnonzero(np.r_[True, tiles[1:] != tiles[:-1], True]) if len(tiles) else []
            for start, end in zip(bounds[:-1], bounds[1:]):
                if held and tiles[start] != tile and (links := found()):
                    yield links
                tile = tiles[start]
                held.append(batch.slice(start, end - start))
        if held and (links := found()):
            yield links

    return rows.select("tile", "chunk", "root", "hashes").mapInArrow(run, "u long, v long")


def similar_roots(marked: DataFrame, links: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(fp, root) for each fingerprint: joined are those that `links` (u, v) connect and those of documents with shingle sets of at least `similarity`.

    `marked` has signatures by (__simhash_id, __simhash_th), `texts` the documents. For a start the root of a fingerprint is the least
    one that it is linked with, so most of what links connect has one already. Documents that share a MinHash band and have
    different roots are compared by their exact sets. No pair is listed: each document lives in a chunk, chunks that
    some band has in common meet in a tile, and tasks compare within tiles, so a group of any size is spread over many. A chunk has
    documents of one home, the largest band of those that their own bands hold, and about TILE_SHINGLES shingles, so that like
    documents live in few chunks and are copied to few tiles.
    """
    fps = marked.select("fp").distinct()
    least = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).groupBy("u").agg(F.min("v").alias("least"))
    roots = fps.join(least.withColumnRenamed("u", "fp"), "fp", "left").select("fp", F.least("fp", "least").alias("root"))
    placed = marked.where("n > 0").select("whole", "fp").distinct().join(roots, "fp").select("whole", "root").distinct()
    own = cut(placed.groupBy("whole").agg(F.min("root").alias("root"), F.max("root").alias("other")))
    # Documents with equal sets but different fingerprints (other numbers of repeats) are one.
    equal = placed.join(own.where("root < other").select("whole", F.col("root").alias("v")), "whole").where("root <> v").select(F.col("root").alias("u"), "v")
    one = F.min_by(F.struct("__simhash_id", "__simhash_th", "n", "bands"), F.struct(F.col("__simhash_id").isNull(), "__simhash_id", "__simhash_th"))
    sets = cut(marked.where("n > 0").groupBy("whole").agg(one.alias("one")).select("whole", "one.*").join(own.select("whole", "root"), "whole"))
    keyed = sets.select(F.explode("bands").alias("key"), "whole", "root")
    meeting = keyed.groupBy("key").agg(F.count("*").alias("members"), F.min("root").alias("a"), F.max("root").alias("b")).where("a < b").select("key", "members")
    met = cut(keyed.join(meeting, "key").select("key", "members", "whole"))
    nearest = met.groupBy("whole").agg(F.max(F.struct("members", "key")).alias("home"))
    by_band = met.join(nearest, "whole").groupBy("key").agg(F.max("home").alias("home"))
    homes = met.select("key", "whole").join(by_band, "key").groupBy("whole").agg(F.max("home").alias("home"))
    lives = homes.select("whole", F.col("home.key").alias("home")).join(sets.drop("bands"), "whole")
    wide = lives.groupBy("home").agg(F.ceil(F.sum("n") / TILE_SHINGLES).cast("int").alias("chunks"))
    lives = cut(lives.join(wide, "home").withColumn("chunk", F.xxhash64("home", F.pmod(F.xxhash64("whole"), F.col("chunks")))).drop("home", "chunks", "n"))
    free_shuffles(marked.sparkSession)
    in_bands = met.select("key", "whole").join(lives.select("whole", "chunk"), "whole").select("key", "chunk").distinct()
    tiles = in_bands.toDF("key", "a").join(in_bands.toDF("key", "b"), "key").where("a <= b").select("a", "b").distinct().withColumn("tile", F.xxhash64("a", "b"))
    where = tiles.select("tile", F.explode(F.array_distinct(F.array("a", "b"))).alias("chunk"))
    read = texts.join(lives.select("whole", F.col("__simhash_id").alias("set_id"), F.col("__simhash_th").alias("set_th")).hint("shuffle_hash"), F.col("__simhash_id").eqNullSafe(F.col("set_id")) & (F.col("__simhash_th") == F.col("set_th")))
    hashes = shingle_sets(read.select("whole", "__simhash_text"), shingle).groupBy("whole").agg(F.first("hashes").alias("hashes"))
    rows = lives.select("whole", "root", "chunk").join(hashes, "whole").join(where, "chunk").select("tile", "chunk", "root", "hashes")
    linked = cut(similar_links(rows.repartition(F.col("tile")).sortWithinPartitions("tile"), similarity))
    free_shuffles(marked.sparkSession)
    joined = connected_components(linked.unionByName(equal).unionByName(links)).withColumnRenamed("node", "fp")
    out = cut(fps.join(joined, "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    for read_no_more in (own, sets, met, lives):
        drop_cut(read_no_more)
    return out


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, radius: int = 4, similarity: float = 0.8) -> DataFrame:
    """One row of each group of near-duplicates: that with the smallest id (null last), then the smallest text hash.

    Documents are linked if their fingerprints differ in at most `radius` bits, or if their sets of shingles have a Jaccard
    similarity of at least `similarity`. Rows with equal id and text are one document, of which one row stays. All columns are
    kept; names that begin with `__simhash_` are reserved.
    """
    hashed = docs.withColumn("__simhash_id", F.col(id_col)).withColumn("__simhash_th", F.xxhash64(F.coalesce(F.col(text_col), F.lit("")), F.col(text_col).isNull()))
    marked = cut(signatures(hashed, ["__simhash_id", "__simhash_th"], text_col, shingle))
    texts = hashed.select("__simhash_id", "__simhash_th", F.col(text_col).cast("string").alias("__simhash_text"))
    links = cut(fingerprint_links(cut(marked.select("fp").distinct()), radius))
    roots = similar_roots(marked, links, texts, shingle, similarity)
    drop_cut(links)
    first = F.min(F.struct(F.col("__simhash_id").isNull().alias("none"), F.col("__simhash_id").alias("id"), F.col("__simhash_th").alias("th")))
    classes = marked.groupBy("fp").agg(first.alias("first")).join(roots, "fp")
    kept = classes.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.id").alias("kept_id"), F.col("first.th").alias("kept_th"))
    # What stays is few beside the texts: it is the side that is hashed, so texts are not sorted.
    stay = hashed.join(cut(kept).hint("shuffle_hash"), F.col("__simhash_id").eqNullSafe(F.col("kept_id")) & (F.col("__simhash_th") == F.col("kept_th")), "left_semi")
    return stay.dropDuplicates(["__simhash_id", "__simhash_th"]).drop("__simhash_id", "__simhash_th")
