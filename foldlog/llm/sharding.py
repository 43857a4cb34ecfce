"""Shards of near-equal bytes by a k-d tree over document metadata, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import table, written

COORD_BITS, TIE_BITS, ROUND_BITS = 20, 42, 12
BLOCK_ROWS = 4096


def _dimensions(docs: DataFrame) -> dict[str, Column]:
    """Metadata dimensions as integers of COORD_BITS bits; a null is 0."""
    top = (1 << COORD_BITS) - 1
    code = lambda c: F.coalesce(F.shiftrightunsigned(F.xxhash64(c), 64 - COORD_BITS), F.lit(0))
    dims = {c: F.when(F.col(c).isNull(), 0).otherwise(code(F.col(c))) for c in ("lang", "source") if c in docs.columns}
    # a doubling of the size is 1/40 of this dimension, whatever the corpus
    return dims | {"size": F.least(F.floor(F.log2(F.col("size").cast("double")) * (top / 40)), F.lit(top)).cast("long")}


def _split_points(meta: DataFrame, nodes: dict[int, int], dims: list[str], tolerance: float) -> dict[int, tuple[str, int]]:
    """For each node that holds more than one shard: its widest dimension and the key below which rows go left.

    The driver sees a minimum and a maximum per node and dimension, and at most 2**ROUND_BITS sums per node a
    round, however many rows there are.
    """
    live = [n for n, k in nodes.items() if k > 1]
    spans = meta.where(F.col("node").isin(live)).groupBy("node").agg(
        F.sum("size").alias("w"), *(f(d).alias(f"{x}_{d}") for d in dims for x, f in (("lo", F.min), ("hi", F.max)))
    )
    widest, target = {}, {}
    for r in spans.collect():
        n = r["node"]
        widest[n] = max(dims, key=lambda d, r=r: (r[f"hi_{d}"] - r[f"lo_{d}"], -dims.index(d)))
        target[n] = (r["w"] * (nodes[n] // 2) / nodes[n], r["w"])
    low, width = dict.fromkeys(widest, 0), COORD_BITS + TIE_BITS  # keys are below 2**62
    below = dict.fromkeys(widest, 0.0)
    open_nodes, cut = set(widest), {}
    while open_nodes and width > 0:
        step = max(0, width - ROUND_BITS)
        pick = F.create_map(*(F.lit(x) for n in open_nodes for x in (n, dims.index(widest[n]))))
        base = F.create_map(*(F.lit(x) for n in open_nodes for x in (n, low[n])))[F.col("node")]
        key = F.shiftleft(F.get(F.array(*dims), pick[F.col("node")]), TIE_BITS) + F.col("tie")
        sums = (
            meta.where(F.col("node").isin(sorted(open_nodes)))
            .select("node", "size", (key - base).alias("off"))
            .withColumn("b", F.shiftright("off", step))
            .where((F.col("off") >= 0) & (F.col("off") < (1 << width)))
            .groupBy("node", "b").agg(F.sum("size").alias("w"))
        )
        by_node: dict[int, list] = {}
        for r in sums.collect():
            by_node.setdefault(r["node"], []).append((r["b"], r["w"]))
        for n in list(open_nodes):
            goal, whole = target[n]
            for b, w in sorted(by_node.get(n, [])):
                if below[n] + w > goal:
                    start = low[n] + (b << step)
                    if step == 0 or w <= tolerance * whole:
                        near = below[n] + w - goal < goal - below[n]
                        cut[n] = start + ((1 << step) if near else 0)
                        open_nodes.discard(n)
                    low[n] = start
                    break
                below[n] += w
            else:
                cut[n] = low[n] + (1 << width)
                open_nodes.discard(n)
        width = step
    return {n: (widest[n], cut[n]) for n in widest}


def _told_apart(rows: DataFrame) -> DataFrame:
    """rows with copy, a number among equal rows. They are counted as one row before the shuffle, and dealt out again in blocks."""
    counted = rows.groupBy(*rows.columns).agg(F.count("*").alias("copies"))
    blocks = counted.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / BLOCK_ROWS))))
    first = F.col("block") * BLOCK_ROWS
    # a group's first block stays where it is; the others go out, so that no task writes a whole group
    copies = F.explode(F.sequence(first, F.least(first + BLOCK_ROWS, F.col("copies")) - 1)).alias("copy")
    rest = blocks.where("block > 0").repartition("text_crc32", "size", "block")
    return blocks.where("block = 0").unionByName(rest).select(*rows.columns, copies)


def _key(dim: str) -> Column:
    return F.shiftleft(F.col(dim), TIE_BITS) + F.col("tie")


def kd_shards(docs: DataFrame, n_shards: int = 24, tolerance: float = 1e-4, slot_rows: int = 20_000) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row of docs.

    A node of the tree stands for a number of shards. It is cut along its widest dimension (language, source,
    log size) at the weighted median, or at the weighted quantile that leaves each side bytes for its whole
    number of shards, until each node is one shard. The quantile comes from sums over ever finer key ranges, so
    no sort and no row leaves the executors; rows that tie in a dimension are parted by a hash of doc_id and text,
    so a hot source or a group of copies is cut like anything else. Slots count from 0 without gaps: rows
    are numbered within hashed buckets of about slot_rows rows, each starting where the one before ends.

    Null text: 0 bytes and crc 0. Null source or lang: coordinate 0. Repeated rows each get their own slot.
    An empty table gives an empty result. Columns other than those named are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    meta = docs.select(
        "doc_id", *[c for c in ("lang", "source") if c in docs.columns],
        (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
    )
    dims = _dimensions(meta)
    rows = _told_apart(meta.select("doc_id", "size", "text_crc32", *(c.cast("long").alias(f"d_{n}") for n, c in dims.items())))
    meta = written(rows.withColumn("tie", F.shiftrightunsigned(F.xxhash64("doc_id", "text_crc32", "copy"), 64 - TIE_BITS)).drop("copy"), "kd-meta")
    names = [f"d_{n}" for n in dims]
    tree, nodes, now = {}, {1: n_shards}, meta.withColumn("node", F.lit(1).cast("long"))
    while any(k > 1 for k in nodes.values()):
        cuts = _split_points(now, nodes, names, tolerance)
        step = F.col("node")
        for dim in names:
            at = F.create_map(*(F.lit(x) for n, (d, c) in cuts.items() if d == dim for x in (n, c)))
            mine = [n for n, (d, _) in cuts.items() if d == dim]
            if mine:
                right = (_key(dim) >= at[F.col("node")]).cast("long")
                step = F.when(F.col("node").isin(mine), 2 * F.col("node") + right).otherwise(step)
        now = written(now.withColumn("node", step), "kd-level")
        tree |= cuts
        grown = {}
        for n, k in nodes.items():
            grown |= {2 * n: k // 2, 2 * n + 1: k - k // 2} if n in cuts else {n: 1}
        nodes = grown
    order = {n: i for i, n in enumerate(sorted(nodes, key=lambda n: bin(n)[3:]))}
    shard = F.create_map(*(F.lit(x) for kv in order.items() for x in kv))[F.col("node")]
    buckets = max(1, meta.count() // slot_rows)
    out = now.select("doc_id", "size", "text_crc32", shard.cast("int").alias("shard"), F.pmod(F.xxhash64("tie"), F.lit(buckets)).alias("bucket"))
    at = W.partitionBy("shard").orderBy("bucket")
    starts = out.groupBy("shard", "bucket").agg(F.count("*").alias("n")).select(
        "shard", "bucket", (F.sum("n").over(at) - F.col("n")).alias("start"))
    numbered = out.withColumn("rn", F.row_number().over(W.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")))
    return numbered.join(starts, ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("rn") - 1).cast("long").alias("slot"))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = kd_shards(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
