"""Near-duplicate groups by min-max hashing, banding, exact confirmation and connected components.

Each permutation of a document's shingle hashes yields two signature values, its minimum and its maximum,
so 64 permutations give 128 values; both agree between two sets with their Jaccard similarity as
probability, and together they vary less than minima of 128 permutations. Bands of five values name buckets. Pairs at
0.85 share none of the 25 bands with probability 4e-7, at 0.9 with 5e-10.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import connected_components
from tidemark.llm.ordering import small
from tidemark.llm.scratch import Scratch, bound_batches
from tidemark.llm.words import column_sets, mix, seeds

PERMUTATIONS, ROWS = 64, 5
#: Candidate ids up to this many (16 MB) are broadcast to pick texts; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000
#: Buckets of up to this many open members are finished by a join of pairs, larger ones in blocks of about BLOCK members, after this
#: many rounds with a new pivot each.
SMALL_BUCKET, BLOCK, PIVOT_ROUNDS = 32, 256, 2


def signatures(sets: list[np.ndarray], permutations: int = PERMUTATIONS) -> np.ndarray:
    """The minima, then the maxima, of each non-empty set under every permutation: (sets, 2 * permutations)."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), 2 * permutations), np.uint64)
    for k, (a, b) in enumerate(zip(seeds(permutations, 1), seeds(permutations, 2), strict=True)):
        values = flat * a + b
        out[:, k] = np.minimum.reduceat(values, starts)
        out[:, permutations + k] = np.maximum.reduceat(values, starts)
    return out


def band_keys(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key for each band of `rows` values; the band's number is part of it."""
    bands = signature.shape[1] // rows
    keys = np.tile(seeds(bands, 3), (len(signature), 1))
    for j in range(rows):
        keys = mix(keys + signature[:, j : bands * rows : rows])
    return keys


def _sketch(size: int, permutations: int, rows: int):
    bands = 2 * permutations // rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(column_sets(batch.column(1), size))
            keys = np.zeros((len(sets), bands), np.uint64)
            full = [i for i, s in enumerate(sets) if len(s)]
            for at in range(0, len(full), 256):
                part = full[at : at + 256]
                keys[part] = band_keys(signatures([sets[i] for i in part], permutations), rows)
            counts = np.array([bands if len(s) else 0 for s in sets])
            values = keys[counts > 0].reshape(-1).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s, digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(values)),
                ],
                ["doc_id", "n_shingles", "set_key", "bands"],
            )

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(column_sets(batch.column(1), size))
            ends = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
            values = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))], ["id", "shingles"])

    return run


def _alike(shared, n_a, n_b, percent: int):
    return shared * 100 >= (n_a + n_b - shared) * percent


def near_groups(docs: DataFrame, *, shingle: int = 5, percent: int = 80, permutations: int = PERMUTATIONS, rows: int = ROWS) -> DataFrame:
    """Group documents whose shingle sets are alike: (doc_id, n_shingles, component_id, kept), a row per row of ``docs``.

    Two documents are linked if 100 * intersection >= percent * union on their full sets of `shingle`-word
    shingles. ``component_id`` is the smallest doc_id reachable over links, ``kept`` whether it is the row's own.

    1. Each text becomes a set key and band keys, in one pass; equal sets merge into one class by a pre-aggregated minimum.
    2. In every bucket the other classes are paired with its smallest one, and pairs confirmed on full sets. Classes of one doc_id are linked too.
    3. Of large buckets that still hold several components, what is outside of the largest one is paired with new
       pivots from it.
    4. Buckets that still hold several components are finished exactly: shingles that only one document of them has bound its
       similarity to any other; what the bound leaves is compared across components. In large buckets only documents outside of the
       largest component are held against the others, block by block, and a block returns the links that join components.

    Null or wordless texts: n_shingles 0, linked with nothing. Null doc_id: takes no part; component_id null, kept
    true. Rows that repeat a doc_id are one document, linked with all that any of its texts is linked with, and kept
    alike. Other columns are ignored. An empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    bound_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    sketch = scratch.keep(
        texts.mapInArrow(_sketch(shingle, permutations, rows), "doc_id long, n_shingles long, set_key binary, bands array<long>"), "sketch"
    )
    classes = scratch.keep(
        sketch.where("doc_id is not null and set_key is not null")
        .groupBy("set_key")
        .agg(F.min("doc_id").alias("id"), F.min("n_shingles").alias("n"), F.first("bands").alias("bands")),
        "classes",
    )
    in_bucket = classes.select("id", "n", F.explode("bands").alias("bucket"))
    least = in_bucket.groupBy("bucket").agg(F.min("id").alias("pivot"), F.max("id").alias("top"), F.count("*").alias("members"))
    shared = scratch.keep(least.where("pivot < top").drop("top"), "shared")
    buckets = scratch.keep(in_bucket.join(small(shared), "bucket").select("bucket", "members", "pivot", "id", "n"), "buckets")
    star = scratch.keep(buckets.where("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct(), "star")

    wanted = scratch.keep(buckets.select("id").distinct(), "wanted")
    if wanted.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    chosen = texts.join(wanted, texts["doc_id"] == wanted["id"], "left_semi")
    sets = scratch.keep(
        chosen.mapInArrow(_sets(shingle), "id long, shingles array<long>").where("size(shingles) > 0"), "sets"
    )

    def confirmed(pairs: DataFrame) -> DataFrame:
        a = sets.select(F.col("id").alias("a"), F.col("shingles").alias("set_a"))
        b = sets.select(F.col("id").alias("b"), F.col("shingles").alias("set_b"))
        both = pairs.join(b, "b").where(F.size("set_b") > 0).join(a, "a")
        fit = F.least(F.size("set_a"), F.size("set_b")) * 100 >= F.greatest(F.size("set_a"), F.size("set_b")) * percent
        return both.where(fit & _alike(F.size(F.array_intersect("set_a", "set_b")), F.size("set_a"), F.size("set_b"), percent)).select("a", "b")

    links = scratch.keep(confirmed(star).union(_of_one_id(sketch, classes)), "links")
    components = connected_components(links, scratch, "first")
    open_rows = scratch.keep(_open_rows(buckets.where("members > 2"), components, scratch, "open"), "open")
    for turn in range(PIVOT_ROUNDS):
        pivots = scratch.keep(_largest(open_rows, turn).where(F.col("members") > SMALL_BUCKET), f"pivots-{turn}")
        outside = open_rows.join(small(pivots), "bucket").where(F.col("component") != F.col("largest"))
        pairs = outside.select(F.least("pivot", "id").alias("a"), F.greatest("pivot", "id").alias("b")).distinct().join(star, ["a", "b"], "left_anti")
        more = scratch.keep(confirmed(pairs), f"links-{turn}")
        if more.isEmpty():
            break
        links = links.union(more)
        components = connected_components(links, scratch, f"again-{turn}")
        open_rows = scratch.keep(_open_rows(open_rows, components, scratch, f"open-{turn}"), f"open-{turn}")

    bounds = _bounded(open_rows.select("id").distinct(), sets, scratch, percent)
    rest = scratch.keep(open_rows.select("bucket", "id", "component").join(bounds, "id"), "bounded")
    sizes = scratch.keep(_largest(rest, 0).where("members > in_largest"), "sizes")
    few = rest.join(small(sizes.where(F.col("members") <= SMALL_BUCKET)), "bucket", "left_semi")
    left, right = (few.select("bucket", *(F.col(c).alias(f"{c}_{s}") for c in ("id", "n", "own", "component"))) for s in "xy")
    most = F.least(F.col("n_x") - F.col("own_x"), F.col("n_y") - F.col("own_y"))
    across = (
        left.join(right, "bucket")
        .where((F.col("component_x") < F.col("component_y")) & _alike(most, F.col("n_x"), F.col("n_y"), percent))
        .select(F.least("id_x", "id_y").alias("a"), F.greatest("id_x", "id_y").alias("b"))
        .distinct()
        .join(star, ["a", "b"], "left_anti")
    )
    large = rest.join(small(sizes.where(F.col("members") > SMALL_BUCKET)), "bucket")
    more = scratch.keep(confirmed(scratch.keep(across, "across")).union(_links_in_blocks(large, sets, percent)), "more")
    if not more.isEmpty():
        components = connected_components(links.union(more), scratch, "final")
    found = classes.select("set_key", "id").join(components.withColumnRenamed("node", "id"), "id", "left")
    groups = scratch.keep(found.select("set_key", F.coalesce("component", "id").alias("component_id")), "groups")
    scratch.keep_only("sketch", "groups")
    return _labelled(sketch.select("doc_id", "n_shingles", "set_key"), groups)


def _of_one_id(sketch: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b): links between the classes of a doc_id that has several texts."""
    known = sketch.where("doc_id is not null and set_key is not null").select("doc_id", "set_key")
    several = known.groupBy("doc_id").agg(F.min("set_key").alias("low"), F.max("set_key").alias("high")).where("low < high").select("doc_id")
    ids = known.join(several, "doc_id", "left_semi").join(classes.select("set_key", "id"), "set_key").select("doc_id", "id").distinct()
    least = ids.groupBy("doc_id").agg(F.min("id").alias("a"))
    return ids.join(least, "doc_id").where("a < id").select("a", F.col("id").alias("b"))


def _open_rows(rows: DataFrame, components: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """rows(bucket, id, n) with their component, of the buckets that hold several.

    Few buckets do, so rows are held against their list where it is small, and a large bucket's rows need not meet in a task.
    """
    labelled = rows.select("bucket", "id", "n").join(components.withColumnRenamed("node", "id"), "id", "left")
    labelled = scratch.keep(labelled.withColumn("component", F.coalesce("component", "id")), f"{name}-labelled")
    several = labelled.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("bucket")
    return labelled.join(small(scratch.keep(several, f"{name}-several")), "bucket", "left_semi")


def _largest(rows: DataFrame, turn: int) -> DataFrame:
    """(bucket, members, largest, in_largest, pivot): each bucket's component with most members there, and one of those, another each turn."""
    each = rows.groupBy("bucket", "component").agg(F.count("*").alias("n"), F.min_by("id", F.xxhash64("id", F.lit(turn))).alias("pivot"))
    top = F.max(F.struct("n", "component", "pivot")).alias("top")
    found = each.groupBy("bucket").agg(F.sum("n").alias("members"), top)
    return found.select("bucket", "members", F.col("top.component").alias("largest"), F.col("top.n").alias("in_largest"), F.col("top.pivot").alias("pivot"))


def _bounded(ids: DataFrame, sets: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """(id, n, own): of the documents whose similarity to another can reach percent, the set's size and its shingles that no other has.

    ``own`` shingles can't be shared, so (n - own) / n bounds the similarity; documents below leave, and the rest are counted anew. Sets
    are told apart by a number of their own, since a doc_id can have several; of its bounds the loosest holds.
    """
    kept = scratch.keep(sets.join(ids, "id", "left_semi").withColumn("of", F.monotonically_increasing_id()), "bound-0")
    for turn in (1, 2):
        each = kept.select("of", F.explode("shingles").alias("s"))
        alone = each.groupBy("s").agg(F.min("of").alias("of"), F.count("*").alias("c")).where("c = 1").groupBy("of").agg(F.count("*").alias("own"))
        counted = kept.select("of", "id", "shingles").join(alone, "of", "left")
        counted = counted.select("of", "id", "shingles", F.size("shingles").cast("long").alias("n"), F.coalesce("own", F.lit(0)).alias("own"))
        kept = scratch.keep(counted.where((F.col("n") - F.col("own")) * 100 >= F.col("n") * percent), f"bound-{turn}")
    return kept.select("id", "n", "own")


def _block_links(percent: int):
    """Members outside of the largest component (first) against others (second): a link for each two components that become one."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        ids, component = rows["id"].to_numpy(), rows["component"].to_numpy()
        counts = rows["shingles"].map(len).to_numpy()
        _, codes = np.unique(np.concatenate(rows["shingles"].to_list()), return_inverse=True)
        starts = np.cumsum(counts) - counts
        mark = np.zeros(codes.max() + 1, np.int32)
        is_first = rows["is_first"].to_numpy()
        first, second = np.flatnonzero(is_first), np.flatnonzero(~is_first)
        joined: dict[int, int] = {}

        def root(c: int) -> int:
            while c in joined:
                c = joined[c]
            return c

        found = []
        for i in first if len(second) else ():
            own = codes[starts[i] : starts[i] + counts[i]]
            mark[own] = 1
            shared = np.add.reduceat(mark[codes], starts)[second]
            mark[own] = 0
            alike = (100 * shared >= percent * (counts[i] + counts[second] - shared)) & (component[second] != component[i])
            others, at = np.unique(component[second[alike]], return_index=True)
            for c, j in zip(others.tolist(), second[alike][at], strict=True):
                if (x := root(int(component[i]))) != (y := root(c)):
                    joined[max(x, y)] = min(x, y)
                    found.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return run


def _links_in_blocks(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links across the components of members(bucket, id, component, members, largest, in_largest).

    The members outside of a bucket's largest component, in chunks, meet all members, in blocks, in a task each, on full sets. With o of m
    outside, o * m / BLOCK + m * ceil(o / BLOCK) sets move: in proportion to m while o is small.
    """
    outside = F.col("members") - F.col("in_largest")
    chunks, blocks = (F.ceil(x / BLOCK).cast("int") for x in (outside, F.col("members")))
    all_of = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    row = ("bucket", "chunk", "block", "id", "component")
    own = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), n).cast("int")
    first = members.where(F.col("component") != F.col("largest")).select("*", own(chunks, 1).alias("chunk"), all_of(blocks).alias("block"))
    second = members.select("*", own(blocks, 2).alias("block"), all_of(chunks).alias("chunk"))
    dealt = first.select(*row, F.lit(True).alias("is_first")).union(second.select(*row, F.lit(False).alias("is_first")))
    return dealt.join(sets, "id").groupBy("bucket", "chunk", "block").applyInPandas(_block_links(percent), "a long, b long").distinct()


def _labelled(sketch: DataFrame, groups: DataFrame) -> DataFrame:
    """Give each row its class's component.

    Both sides are read from storage, so adaptive execution can split the rows of a text that a third of all rows repeat.
    """
    out = sketch.join(groups, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept")
    )


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one document of each near-duplicate group, that with the smallest doc_id.

    Rows without doc_id stay. Of rows that repeat a doc_id the smallest by all columns stays.
    """
    groups = near_groups(docs, **options)
    gone = groups.where("not kept").select(F.col("doc_id").alias("gone")).distinct()
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    left = docs.join(gone, docs["doc_id"] == gone["gone"], "left_anti")
    if groups.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        return left
    once = left.where("doc_id is not null").groupBy(F.col("doc_id").alias("of")).agg(F.min(F.struct(*docs.columns)).alias("row"))
    return once.select("row.*").union(left.where("doc_id is null"))
