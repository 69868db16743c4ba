"""Near-duplicate classes: DartMinHash signatures, banded joining, exact check, connected components.

Documents whose weighted Jaccard similarity over five-word shingles (weights: occurrences) is at least
``threshold`` are linked; a class is a connected component. Steps:

1. Each text gives a hash of its word sequence (its node), ``bands`` band hashes of ``rows`` signature
   coordinates, the coordinates' low bytes, and its shingles. Equal word sequences are one node.
2. Nodes that share a band meet in a bucket. A bucket never emits its pairs: in each of ``rounds``
   rounds it names one leader, and only (leader, member of another component) pairs are checked, on the
   shingles themselves. So a bucket of n nodes costs n pairs a round.
3. For the rest, buckets that still hold several components are dealt into blocks of at most about
   ``block`` bytes; members outside a bucket's largest component are compared with all others by
   signature, and those that agree in at least ``agree`` of the coordinates are checked on shingles there;
   only links leave the block. A pair that shares a bucket is lost only if its signature lies 4.5 standard
   errors under its similarity (3.4e-6 for a pair at the threshold).

With 20 bands of 4 rows, a pair at similarity 0.8 shares a band with probability 1 - 2.6e-5.

Every join of many rows to one by a bucket, node or component has a written table on its unique side, so
that Spark can split the hot keys of the other.

Defined results: null is the empty text; texts without words link only to equal texts; the class id is
the smallest document id; repeated rows get the class of their text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, documents, materialize, release, slices, unused
from .components import components
from .dart_minhash import U, mix, signatures
from .shingles import jaccard, multiset, shingles

#: Bytes of shingles and signatures that a block holds on either side, about.
BLOCK = 2 << 20


def sketch(df: DataFrame, bands: int = 20, rows: int = 4, size: int = 5) -> DataFrame:
    """row (unique), doc_id, text_hash, node, worded, bands array<long>, signature (one byte a coordinate), shingles (binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()  # what earlier steps kept in this worker
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            for part in slices(batch, 2 << 20, 10_000):
                texts, n = part.column(1).to_pylist(), part.num_rows
                owner, value, times, sequence = shingles(texts, size)
                sig = signatures(owner, value, times.astype(float), n, bands * rows)
                with np.errstate(over="ignore"):
                    key = np.tile(np.arange(bands, dtype=U), (n, 1))
                    for r in range(rows):
                        key = mix(key * U(0x9E3779B97F4A7C15) + sig[:, r::rows])
                for at in np.flatnonzero(sequence == 0):
                    sequence[at] = _blank(texts[at])
                yield pa.RecordBatch.from_pydict(
                    {
                        "row": pa.array(np.arange(row, row + n)),
                        "doc_id": part.column(0),
                        "text_hash": part.column(2),
                        "node": pa.array(sequence.view(np.int64)),
                        "worded": pa.array(np.bincount(owner, minlength=n) > 0),
                        "bands": pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * bands), pa.array(key.ravel().view(np.int64))),
                        "signature": pa.array([r.tobytes() for r in sig.astype(np.uint8)], pa.binary()),
                        "shingles": pa.array(multiset(owner, value, times, n), pa.binary()),
                    }
                )
                row += n

    rows_ = documents(df).withColumn("text_hash", F.xxhash64("text"))
    return rows_.mapInArrow(run, "row long, doc_id long, text_hash long, node long, worded boolean, bands array<long>, signature binary, shingles binary")


def _blank(text: str | None) -> int:
    """The node of a text without words: a hash of the text itself."""
    raw = (text or "").encode("utf-8", "replace")
    return zlib.crc32(raw) << 32 | zlib.adler32(raw)


def _check(pairs: DataFrame, features: DataFrame, threshold: float) -> DataFrame:
    """a, b, linked of each pair, on the shingles."""
    both = pairs.join(features.select(F.col("node").alias("b"), F.col("shingles").alias("right")), "b")
    both = both.join(features.select(F.col("node").alias("a"), F.col("shingles").alias("left")), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sure = [jaccard(x, y) >= threshold for x, y in zip(part.column(2).to_pylist(), part.column(3).to_pylist())]
                yield pa.RecordBatch.from_pydict({"a": part.column(0), "b": part.column(1), "linked": pa.array(sure, pa.bool_())})

    return both.select("a", "b", "left", "right").mapInArrow(run, "a long, b long, linked boolean")


def _with_component(bucketed: DataFrame, comp: DataFrame | None) -> DataFrame:
    if comp is None:
        return bucketed.withColumn("component", F.col("node"))
    return bucketed.join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _led(rows: DataFrame, turn: int) -> DataFrame:
    """(a, b) of each bucket's leader and its members of other components."""
    heads = rows.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("o"), "node", "component")).alias("head"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    heads = materialize(heads.filter("lo < hi").select("bucket", F.col("head.node").alias("leader"), F.col("head.component").alias("own")), "heads")
    pairs = rows.join(heads, "bucket").filter("component <> own").select(F.least("leader", "node").alias("a"), F.greatest("leader", "node").alias("b"))
    return pairs.distinct()


def _rest(rows: DataFrame, features: DataFrame, agree: int, threshold: float, block: int = BLOCK, met: int = 2) -> DataFrame:
    """Linked pairs (a, b) of bucket mates in different components. rows: bucket, band, node, component;
    features: node, bands, signature, shingles, bytes. Buckets of at most ``met`` rows are done (both members
    of a bucket of two meet in the first leader round). A pair that shares several bands is looked at in the first
    of them only, by the band hashes that key the buckets; its signatures must agree in ``agree``
    coordinates, and then its shingles decide. A member needs one link to each other component, so it asks
    the likeliest first and stops at the first that holds. A bucket's rows are copied once for each of its
    blocks; at 2 MB a block and 2 kB a row that is n / 1000 copies."""
    parts = rows.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    buckets = parts.groupBy("bucket").agg(F.sum("n").alias("n"), F.count("*").alias("parts"), F.max(F.struct("n", "component")).alias("top"))
    buckets = materialize(buckets.filter((F.col("parts") > 1) & (F.col("n") > met)).select("bucket", F.col("top.component").alias("largest")), "open")
    rows = rows.join(buckets, "bucket")
    sizes = rows.join(features.select("node", "bytes"), "node").groupBy("bucket").agg(F.ceil(F.sum("bytes") / block).cast("int").alias("blocks"))
    rows = rows.join(materialize(sizes, "blocks"), "bucket").withColumn("mine", F.expr("pmod(hash(node), blocks)").cast("int")).join(features, "node")
    every = F.explode(F.expr("sequence(0, blocks - 1)"))
    keep = ["band", "node", "component", "bands", "signature", "shingles"]
    left = rows.filter("component <> largest").select("*", every.alias("other")).select("bucket", F.col("mine").alias("i"), F.col("other").alias("j"), F.lit(True).alias("asks"), *keep)
    right = rows.select("*", every.alias("other")).select("bucket", F.col("other").alias("i"), F.col("mine").alias("j"), F.lit(False).alias("asks"), *keep)

    def compare(table: pa.Table) -> pa.Table:
        node, comp, asks = (table[c].to_numpy() for c in ("node", "component", "asks"))
        ask, rest = np.flatnonzero(asks), np.flatnonzero(~asks)
        found: list[tuple[int, int]] = []
        if len(ask) and len(rest):
            sig = np.frombuffer(b"".join(table["signature"].to_pylist()), np.uint8).reshape(table.num_rows, -1)
            full = np.asarray(table["bands"].combine_chunks().flatten()).reshape(table.num_rows, -1)
            band, packed = table["band"][0].as_py(), table["shingles"]
            there, their = sig[rest], comp[rest]
            for k in ask:
                score = (there == sig[k]).sum(1)
                done: set[int] = set()
                hit = np.flatnonzero((score >= agree) & (their != comp[k]))
                hit = hit[(full[rest[hit], :band] != full[k, :band]).all(1)]
                mine = packed[int(k)].as_py() if len(hit) else b""
                for at in hit[np.argsort(-score[hit], kind="stable")]:
                    other = int(rest[at])
                    if int(comp[other]) not in done and jaccard(mine, packed[other].as_py()) >= threshold:
                        done.add(int(comp[other]))
                        found.append((int(node[k]), int(node[other])))
        return pa.table({"a": pa.array([min(x) for x in found], pa.int64()), "b": pa.array([max(x) for x in found], pa.int64())})

    return left.unionByName(right).groupBy("bucket", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def classes(df: DataFrame, threshold: float = 0.8, bands: int = 20, rows: int = 4, size: int = 5, rounds: int = 1, agree: int | None = None, block: int = BLOCK) -> DataFrame:
    """doc_id, text_hash, component, class_id for every row. ``component`` tells classes apart that have the
    same class id, when rows of different texts share an id."""
    k = bands * rows
    if agree is None:
        agree = int(k * threshold - 4.5 * np.sqrt(k * threshold * (1 - threshold)))
    table = materialize(sketch(df, bands, rows, size), "sketch")
    # one row stands for the rows of its node
    nodes = table.filter("worded").groupBy("node").agg(F.min("row").alias("row"), F.first("bands").alias("bands"))
    exploded = nodes.select("node", "row", F.posexplode("bands").alias("band", "bucket"))
    shared = materialize(exploded.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket"), "shared")
    # these, like ``kept`` below, grow with the documents: never broadcast, so the plan is the same at every size
    bucketed = materialize(exploded.join(shared.hint("merge"), "bucket").select("bucket", "band", "node", "row"), "buckets")
    wanted = bucketed.select("row").distinct()
    features = materialize(table.join(wanted.hint("merge"), "row", "left_semi").select("node", "bands", "signature", "shingles", (F.length("shingles") + F.length("signature") + 8 * F.size("bands")).alias("bytes")), "features")
    bucketed = bucketed.drop("row")
    checked, comp = None, None
    for turn in range(rounds):
        pairs = _led(_with_component(bucketed, comp), turn)
        if checked is not None:
            pairs = pairs.join(checked, ["a", "b"], "left_anti")
        fresh = materialize(_check(pairs, features, threshold), "checked")
        checked = fresh if checked is None else checked.unionByName(fresh)
        if turn == 0 or not fresh.filter("linked").isEmpty():
            comp = components(checked.filter("linked"))
    rest = materialize(_rest(_with_component(bucketed, comp), features, agree, threshold, block, 2 if rounds else 1), "rest")
    discard(features, bucketed, shared)
    links = rest if checked is None else checked.filter("linked").select("a", "b").unionByName(rest)
    if comp is None or not rest.isEmpty():
        comp = components(links)
    least = table.groupBy("node").agg(F.min("doc_id").alias("first_id")).join(comp, "node", "left")
    least = materialize(least.withColumn("component", F.coalesce("component", "node")), "nodes")
    class_of = materialize(least.groupBy("component").agg(F.min("first_id").alias("class_id")), "classes")
    named = least.join(class_of, "component").select("node", "component", "class_id")
    return table.select("doc_id", "text_hash", "node").join(named, "node").drop("node")


def near_duplicates(df: DataFrame, **params) -> DataFrame:
    """doc_id, class_id for every row; ``params`` are those of ``classes``."""
    return classes(df, **params).select("doc_id", "class_id")


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """The rows of ``df``, all columns, that stand for their class: the one of smallest id (of those, of the
    smallest hash of the text). Rows of equal id and text are copies, whatever their other columns hold; of
    them the one with the smallest hash of all columns stays."""
    found = classes(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), **params)
    found = materialize(found.select("doc_id", "text_hash", "component"), "found")
    # a struct's null id is its smallest
    best = found.groupBy("component").agg(F.min(F.struct("doc_id", "text_hash")).alias("best"))
    id_, hash_, all_ = (unused(df, x) for x in ("kept_id", "kept_hash", "row_hash"))
    kept = materialize(best.select(F.col("best.doc_id").alias(id_), F.col("best.text_hash").alias(hash_)), "kept")
    keys = [F.col(id_col).cast("long"), F.xxhash64(F.col(text_col).cast("string"))]
    # about a row a document: never broadcast, at whatever size
    out = df.join(kept.hint("merge"), keys[0].eqNullSafe(F.col(id_)) & (keys[1] == F.col(hash_)), "left_semi")
    if found.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        return out
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(all_))
    return out.withColumn(all_, F.xxhash64(*df.columns)).withColumn(id_, first).filter(F.col(id_) == 1).drop(all_, id_)
