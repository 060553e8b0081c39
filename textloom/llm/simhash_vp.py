"""SimHash near-duplicates by vantage-point partitions (operator 9).

Fingerprints that differ in RADIUS bits or fewer link; a document's component is the smallest
id that links reach. All pairs are found, none is approximated.

Distinct fingerprints stand for their documents. The 64 bits are cut into blocks; as linked
fingerprints differ in at most RADIUS bits, they agree wholly in some choice of
``blocks - RADIUS`` blocks. Such a choice is a sub-cube whose distances to any vantage point
are equal for linked fingerprints, so shards by it need no overlap: the triangle bound is 0
there. (Shards by distances over all 64 bits alone do need it: random fingerprints lie within
RADIUS of a median border so often that each level of such a tree copies a third of the rows
and saves a fifteenth of the comparisons.) The number of blocks and of bits used follows the
number of fingerprints, so that shards have about SHARD_ROWS rows; it changes cost, never
results. Shards above CHUNK rows, those of crowded fingerprints, are split over the cluster by
vantage points of their own, a level a superstep; rows near a border go to both sides. Where no
vantage point prunes, every pair of a shard's chunks is a shard.

In every shard a vantage-point tree prunes by the triangle bound, see ``tree_pairs``. A shard
gives the links of a spanning forest, not all pairs. Components follow by alternating
large-star and small-star rounds over written tables.

Defined results: null, empty and white-space texts have fingerprint 0 and link like any
other. Rows without an id get a fingerprint and the smallest id of their component, null if none
of its rows has one; they link the rows of others. Ids may be of any type that sorts. Repeated
rows fall in one component. A very long text is hashed shingle by shingle, in memory a few times
its size. An empty table gives no rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from textloom.llm.common import discard, map_texts, materialize, ship_package

RADIUS = 4
SHINGLE = 4
SEED = 42
#: A node of a tree splits if it has more rows, and if its sides' squares come to at most PRUNES of its own.
LEAF = 16
PRUNES = 0.75
#: Rows of a shard that one task may take whole.
CHUNK = 4096
#: Rows a shard should have on average.
SHARD_ROWS = 256
#: Rows a task handles at once, up to the end of a shard.
RUN_ROWS = 400_000


def fingerprint(text: str | None) -> int:
    """64-bit SimHash, unsigned: shingles of four words, A-Z lower-cased, repeats included."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return 0
    if len(words) <= SHINGLE:
        hashes = np.array([xxh64_intdigest(b" ".join(words), SEED)], "<u8")
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.append(0, ends[:-1] + 1)
        hashes = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[: 1 - SHINGLE].tolist(), ends[SHINGLE - 1 :].tolist(), strict=True)], "<u8")
    votes = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 50_000):
        votes += np.unpackbits(hashes[k : k + 50_000].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long)."""

    def run(ids, texts):
        return {"doc_id": ids, "fp": np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64).tolist()}

    return map_texts(df, id_col, text_col, f"doc_id {df.schema[id_col].dataType.simpleString()}, fp long", run)


def ring_pairs(fp: np.ndarray, rows: np.ndarray, node: np.ndarray, d: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs of rows of one node. Rows are sorted by (node, distance to the vantage point): only rings within the radius of each other can hold them."""
    f = fp[rows]
    i, shift = np.arange(len(rows)), 1
    while len(i := i[i + shift < len(rows)]):
        i = i[(node[i] == node[i + shift]) & (d[i + shift] - d[i] <= radius)]
        hit = i[np.bitwise_count(f[i] ^ f[i + shift]) <= radius]
        if len(hit):
            yield rows[hit], rows[hit + shift]
        shift += 1


def tree_pairs(fp: np.ndarray, cell: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows of a cell that link, in batches, some of them twice. Rows are sorted by cell.

    The vantage-point trees of all cells grow side by side, a level a round. A node is split
    at the median distance to its vantage point; the outer side also takes the rows within the
    radius of the border, so that each pair lies wholly in one side. Nodes in which that prunes too
    little are leaves, whose rings are compared.
    """
    rows, node = np.arange(len(fp)), cell
    while len(rows):
        start = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
        size = np.diff(np.append(start, len(rows)))
        which = np.repeat(np.arange(len(size)), size)
        d = np.bitwise_count(fp[rows] ^ fp[rows[start + size // 2]][which]).astype(np.int64)
        order = np.argsort(which * 65 + d, kind="stable")
        rows, d = rows[order], d[order]
        border = d[start + (size - 1) // 2]
        border -= border == d[start + size - 1]
        near, far = d <= border[which], d > border[which] - radius
        inner, outer = (np.add.reduceat(x, start, dtype=np.int64) for x in (near, far))
        split = (size > LEAF) & (inner > 0) & (inner**2 + outer**2 <= PRUNES * size**2)
        on = split[which]
        yield from ring_pairs(fp, rows[~on], which[~on], d[~on], radius)
        node = np.concatenate([2 * which[on & near], 2 * which[on & far] + 1])
        rows = np.concatenate([rows[on & near], rows[on & far]])
        order = np.argsort(node, kind="stable")
        rows, node = rows[order], node[order]


def forest(fp: np.ndarray, cell: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """(fp, smallest fp) links of a forest that spans what links within each cell; fp signed, rows sorted by cell."""
    n = len(fp)
    least = np.arange(n)

    def unite(pairs: list[tuple[np.ndarray, np.ndarray]]) -> None:
        i, j = np.concatenate([a for a, _ in pairs]), np.concatenate([b for _, b in pairs])
        while len(i):
            a, b = least[i], least[j]
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(least, np.maximum(a, b), np.minimum(a, b))
            while not ((up := least[least]) == least).all():
                least[:] = up

    pairs, held = [], 0
    for i, j in tree_pairs(fp.view(np.uint64), cell, radius):
        pairs.append((i, j))
        held += len(i)
        if held > 500_000:
            unite(pairs)
            pairs, held = [], 0
    if pairs:
        unite(pairs)
    # The root of a tree is the first row; the smallest fingerprint of the tree takes its place.
    order = np.lexsort((fp, least))
    head = np.append(True, least[order][1:] != least[order][:-1])
    root = fp[order][np.maximum.accumulate(np.where(head, np.arange(n), 0))]
    out = fp[order]
    keep = out != root
    return out[keep], root[keep]


def routes(blocks: int, bits: int, radius: int = RADIUS) -> list[int]:
    """Bit masks: every choice of ``blocks - radius`` of the blocks, so many bits of each that they make ``bits``."""
    cut = [64 * k // blocks for k in range(blocks + 1)]
    each = -(-bits // (blocks - radius))
    block = [((1 << min(each, cut[k + 1] - cut[k])) - 1) << cut[k] for k in range(blocks)]
    return [sum(x) for x in combinations(block, blocks - radius)]


def routes_for(rows: int, radius: int = RADIUS) -> list[int]:
    """As few routes as give shards of about SHARD_ROWS rows, were the bits even."""
    bits = max(1, (max(1, rows) // max(1, SHARD_ROWS)).bit_length())
    blocks = radius + 1
    while (blocks - radius) * (64 // blocks) < bits and blocks < radius + 5:
        blocks += 1
    return routes(blocks, bits, radius)


def split_large(routed: DataFrame, radius: int = RADIUS) -> tuple[DataFrame, DataFrame]:
    """(rows of shards up to CHUNK rows, rows of larger ones that no vantage point prunes), both fp, shard.

    A superstep splits every larger shard at the median distance to a vantage point of its own;
    rows within the radius outside the border go to both sides.
    """
    spark = routed.sparkSession
    bits = F.bit_count(F.col("fp").bitwiseXOR(F.col("vantage")))
    work, done, stuck = routed, [], []
    while True:
        sizes = work.groupBy("shard").agg(F.count("*").alias("n"), F.min_by("fp", F.xxhash64("fp")).alias("vantage"))
        large = materialize(sizes.where(F.col("n") > CHUNK))
        if large.isEmpty():
            done.append(work)
            break
        done.append(work.join(large, "shard", "left_anti"))
        rows = work.join(large, "shard").withColumn("d", bits)
        rings = rows.groupBy("shard", "n", "d").agg(F.count("*").alias("m")).groupBy("shard", "n").agg(F.sort_array(F.collect_list(F.struct("d", "m"))).alias("r"))
        # At most 65 rings a shard: the first that reaches half of the rows, inside the outermost.
        rings = rings.withColumn("b", F.expr("aggregate(r, named_struct('c', 0L, 'b', -1), (a, x) -> if(2 * a.c >= n, a, named_struct('c', a.c + x.m, 'b', x.d)), a -> a.b)"))
        rings = rings.withColumn("b", F.expr("if(b = element_at(r, -1).d, b - 1, b)"))
        inner, outer = F.expr("aggregate(filter(r, x -> x.d <= b), 0L, (a, x) -> a + x.m)"), F.expr(f"aggregate(filter(r, x -> x.d > b - {radius}), 0L, (a, x) -> a + x.m)")
        pruned = (inner > 0) & (inner.cast("double") ** 2 + outer.cast("double") ** 2 <= PRUNES * F.col("n").cast("double") ** 2)
        borders = materialize(rings.select("shard", F.when(pruned, F.col("b")).alias("b")))
        stuck.append(rows.join(borders.where("b is null"), "shard").select("fp", "shard"))
        if borders.where("b is not null").isEmpty():
            break
        side = lambda k, inside: F.when(inside, F.xxhash64("shard", F.lit(k)))
        sides = F.array_compact(F.array(side(0, F.col("d") <= F.col("b")), side(1, F.col("d") > F.col("b") - radius)))
        work = materialize(rows.join(borders.where("b is not null"), "shard").select("fp", F.explode(sides).alias("shard")))
    union = lambda x: functools.reduce(DataFrame.union, [y.select("fp", "shard") for y in x], spark.createDataFrame([], "fp long, shard long"))
    return union(done), union(stuck)


def near_links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """prints: fp, distinct. Links (u, v) of fingerprints, u > v, that span all groups."""
    spark = prints.sparkSession
    ship_package(spark)
    masks = [m - (1 << 64) if m >> 63 else m for m in routes_for(prints.count(), radius)]
    shard = F.explode(F.array(*[F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(m))) for k, m in enumerate(masks)]))
    routed, stuck = split_large(prints.select("fp", shard.alias("shard")), radius)
    if not stuck.isEmpty():
        # Every pair of a shard's chunks is a shard.
        sizes = materialize(stuck.groupBy("shard").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("n")))
        own = F.pmod(F.xxhash64("fp", F.lit("chunk")), F.col("n")).cast("int")
        pairs = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda k: F.xxhash64(F.col("shard"), F.least(k, own), F.greatest(k, own)))
        routed = routed.union(stuck.join(sizes, "shard").select("fp", F.explode(pairs).alias("shard")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        rows = 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, rows
            fp, cell = (np.concatenate(x) for x in zip(*held, strict=True))
            end = len(cell) if last else int(np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))[-1])
            if end:
                u, v = forest(fp[:end], cell[:end], radius)
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])
            held, rows = [[fp[end:], cell[end:]]], len(cell) - end

        for b in batches:
            held.append([b.column(k).to_numpy() for k in range(2)])
            rows += b.num_rows
            if rows >= RUN_ROWS:
                yield from flush(False)
        if rows:
            yield from flush(True)

    return routed.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, "u long, v long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(u, v), u > v, to (node, root): root is the smallest node reachable; roots have no row.

    Rounds of small-star (a node's smaller neighbours go to the least of them) and large-star
    (a node's larger neighbours go to its least neighbour), each over a written table.
    """
    links = materialize(links)
    while True:
        least = links.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        least = materialize(least)
        open_ = least.where("n > 1").isEmpty() and links.join(least, links["v"] == least["u"], "left_semi").isEmpty()
        if open_:
            discard(links)
            return least.select(F.col("u").alias("node"), F.col("m").alias("root"))
        a, b = links.alias("a"), least.select(F.col("u").alias("k"), "m").alias("b")
        joined = a.join(b, F.col("a.u") == F.col("b.k")).select("u", "v", "m")
        small = joined.select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        starred = materialize(small)
        discard(links, least)
        links = starred
        least = links.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
        large = links.join(least, links["v"] == least["k"], "left").select("u", F.coalesce("m", "v").alias("v"))
        kept = least.select(F.col("k").alias("u"), F.col("m").alias("v"))
        both = materialize(large.union(kept).where("u <> v").distinct())
        discard(links)
        links = both


def join_spread(rows: DataFrame, named: DataFrame, key: str, total: int) -> DataFrame:
    """rows with named's columns; named has each key once and n, the rows that have it.

    Keys with over a thousandth of the rows are under a thousand: they go by broadcast, so that no task gets a hot one.
    """
    hot = named.where(F.col("n") * 1000 > total).drop("n")
    cold = named.where(F.col("n") * 1000 <= total).drop("n")
    few = rows.join(F.broadcast(hot), key)
    return few.unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (of the type of the ids) for every row."""
    prints = materialize(fingerprints(df, id_col, text_col))
    groups = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("id"), F.count("*").alias("n")))
    count = groups.agg(F.count("*").alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    root = components(near_links(groups.select("fp"), radius))
    named = materialize(groups.join(root, groups["fp"] == root["node"], "left").select("fp", "id", F.col("n").alias("rows"), F.coalesce("root", "fp").alias("root")))
    whole = materialize(named.groupBy("root").agg(F.min("id").alias("component_id"), F.count("*").alias("n")))
    named = join_spread(named, whole, "root", count["groups"])
    joined = join_spread(prints, materialize(named.select("fp", "component_id", F.col("rows").alias("n"))), "fp", count["rows"])
    return joined.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: Rows that a broadcast may hold, of two longs each.
BROADCAST_ROWS = 500_000


def row_keys(df: DataFrame) -> tuple[DataFrame, str]:
    """The rows with a key of their own, a struct of two longs that no later read changes, and the key's name.

    Rows of files have one in their file and place; others are written to the shared folder with a number.
    """
    key = "_row"
    while key in {c.lower() for c in df.columns}:
        key += "_"
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    if plan.nodeName() == "LogicalRelation" and "_metadata" not in {c.lower() for c in df.columns}:
        try:
            file = F.xxhash64("_metadata.file_path")
            named = df.select("*", F.struct(file.alias("a"), F.col("_metadata.row_index").alias("b")).alias(key))
            told_apart = df.select(F.count_distinct("_metadata.file_path") == F.count_distinct(file)).first()[0]
        except AnalysisException:
            told_apart = False  # a format without places
        if told_apart:
            return named, key
    return materialize(df.select("*", F.struct(F.lit(0).cast("long").alias("a"), F.monotonically_increasing_id().alias("b")).alias(key))), key


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row of each group of near-duplicates, with all its columns: that of the smallest id, one without an id only where none has one."""
    rows, key = row_keys(df)
    # Of a text and id that occur twice any row may stay; texts of one id are told apart by their hash.
    place = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"), F.col(key).alias("row"))
    groups = materialize(near_duplicates(rows.select(place.alias("place"), F.col(text_col).alias("text")), "place", "text", radius).select(F.col("doc_id").alias("place"), "component_id"))
    go = materialize(groups.where(F.col("place") != F.col("component_id")).select(F.col("place.row").alias(key)))
    discard(groups)
    small = go.count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(go) if small else go, key, "left_anti").select(*df.columns)
