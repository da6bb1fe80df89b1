"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled by a hash and queued, again behind themselves if the source may be repeated. A document's virtual
finish time is the source's words up to its end, divided by the source's target; a long document is queued in packets, as in a
network, so that it cannot hold up the other sources. All packets are range-sorted by finish time and the sequence is cut at the
total budget: at any point of it, the cut included, every source has been served in proportion to its target.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.ordering import running_total, small
from tidemark.llm.scratch import Scratch

WORD = r"[^\x20\x09-\x0D]+"
#: Words of a packet at most; how far a source can be from its target where the mix is cut.
PACKET = 128


def source_targets(sizes: DataFrame, scratch: Scratch, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """(source, source_size, target, earlier) of sizes(source, source_size).

    The i-th source by code point, null last, weighs ``weights[i % len(weights)]``. Targets share ``share`` of all sizes by
    weight; a target above cap * source_size stops there, and what it leaves is shared again until none is above.
    ``earlier`` is the total size of the sources before it.

    Sources stop in the order of top / weight. While those before a source are stopped, the level of the others is what is left over
    the weight that is left; it rises up to the first source that does not stop and falls after it, so the level of the end
    is the highest of these.
    """
    order = [F.col("source").asc_nulls_last()]
    ranked = running_total(sizes.withColumn("one", F.lit(1).cast("long")), order, "one", "place", scratch, "ranked").drop("one")
    spaced = running_total(ranked, order, "source_size", "upto", scratch, "spaced")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), F.pmod(F.col("place") - 1, F.lit(len(weights))).cast("int") + 1)
    sources = spaced.select("source", "source_size", (F.col("upto") - F.col("source_size")).alias("earlier"), weight.alias("weight"))
    sources = sources.withColumn("top", F.col("source_size") * F.lit(float(cap)))
    stops = [(F.col("top") / F.col("weight")).asc(), *order]
    held = running_total(sources, stops, "top", "held", scratch, "held")
    heavy = running_total(held, stops, "weight", "heavy", scratch, "heavy")
    size, weighs = heavy.agg(F.sum("source_size"), F.sum("weight")).first()
    left = F.lit((size or 0) * float(share)) - (F.col("held") - F.col("top"))
    level = heavy.agg(F.max(left / F.greatest(F.col("weight"), F.lit(weighs or 0.0) - (F.col("heavy") - F.col("weight"))))).first()[0]
    return heavy.select("source", "source_size", F.least(F.col("weight") * F.lit(level or 0.0), F.col("top")).alias("target"), "earlier")


def _taken(rows: DataFrame, scratch: Scratch, *, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, budget: int | None = None, seed: int = 7) -> DataFrame:
    """(row, doc_id, source, shuffle_key, size, source_size, target, taken) of rows(doc_id, source, text, row). ``row`` is unique."""
    key = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    thin = rows.select(F.col("row"), F.col("doc_id").cast("long").alias("doc_id"), "source", key.alias("shuffle_key"), size.alias("size"))
    thin = scratch.keep(thin, "thin")
    sources = source_targets(thin.groupBy("source").agg(F.sum("size").alias("source_size")), scratch, weights, share, cap)
    total, least = sources.agg(F.sum("source_size"), F.min(F.when(F.col("target") > 0, F.col("target")))).first()
    whole = math.floor((total or 0) * min(float(share), float(cap)))
    budget = whole if budget is None else min(budget, whole)

    # ``row`` is unique, so copies of one row, however many, are spread over the ranges
    order = [F.col("source").asc_nulls_last(), F.col("shuffle_key").asc(), F.col("doc_id").asc_nulls_last(), F.col("row").asc()]
    queued = running_total(thin, order, "size", "upto", scratch, "queued")
    of = sources.withColumnRenamed("source", "of")
    queued = queued.join(small(of), queued["source"].eqNullSafe(of["of"])).drop("of")
    turn = F.explode(F.sequence(F.lit(0), F.lit(math.ceil(cap) - 1)))
    packet = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("size") / PACKET).cast("int") - 1)))
    packets = queued.withColumn("turn", turn).withColumn("packet", packet)
    start = F.col("upto") - F.col("size") - F.col("earlier") + F.col("turn") * F.col("source_size") + F.col("packet") * PACKET
    ends = F.floor(F.col("source_size") * F.lit(float(cap))) - start
    words = F.greatest(F.lit(0), F.least(F.lit(PACKET), F.col("size") - F.col("packet") * PACKET, ends)).cast("long")
    finish = F.when(F.col("target") > 0, (start + words) / F.col("target")).otherwise(F.lit(0.0))
    packets = packets.withColumns({"words": words, "finish": finish})
    # a source's packet that is in service at time 1 ends before this time, and then the budget is used up
    latest = 1 + PACKET / least if least else 1.0
    packets = packets.where((F.col("turn") + F.col("packet") == 0) | (F.col("words") > 0) & (F.col("finish") <= latest)).drop("upto", "earlier")
    served = running_total(packets, [F.col("finish").asc(), *order, F.col("turn").asc(), F.col("packet").asc()], "words", "served", scratch, "served")
    scratch.drop("thin", "ranked", "spaced", "held", "heavy", "queued")
    took = F.greatest(F.lit(0), F.least(F.col("words"), F.lit(budget) - (F.col("served") - F.col("words"))))
    return served.groupBy("row", "doc_id", "source", "shuffle_key", "size", "source_size", "target").agg(F.sum(took).cast("long").alias("taken"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The words that the mix takes of each row: (doc_id, source, shuffle_key, size, source_size, target, taken).

    ``weights``, ``share`` and ``cap`` are those of ``source_targets``, by default 5, 2, 1, 1.5 and 2.0; ``seed`` shuffles.
    ``size`` is the number of words, 0 for null or empty texts, which are never taken. Sources are queued up to ``cap`` times their size, in
    one order each turn, and served by finish time until ``budget`` words are taken: by default all targets together, a larger one
    counts as that. So each source ends within a packet of its target, more or less. The packet where the mix ends is cut, and
    no document is taken more than ceil(cap) times. Null sources are one source. Rows that repeat a doc_id are documents of their own, also
    where all columns are equal; among those it is arbitrary which one is cut. Other columns are ignored; no rows give none.
    """
    rows = docs.select("doc_id", "source", "text", F.monotonically_increasing_id().alias("row"))
    return _taken(rows, Scratch(docs.sparkSession, "mix"), **options).drop("row")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself, with the columns of ``docs``: each document as often as the mix takes it.

    The copy that the budget cuts holds its first words, one space between them, and n_chars, where there is one, follows
    it. Documents of which nothing is taken go. A document that is taken twice is two rows with its doc_id. Options, nulls, repeated rows
    and empty tables as in ``mix``.
    """
    scratch = Scratch(docs.sparkSession, "mixed")
    tagged = scratch.keep(docs.select(F.struct(*docs.columns).alias("doc"), F.monotonically_increasing_id().alias("row")), "tagged")
    taken = _taken(tagged.select("doc.doc_id", "doc.source", "doc.text", "row"), scratch, **options)
    taken = taken.where("taken > 0").select("row", "size", "taken")
    got = tagged.join(taken, "row").withColumn("turn", F.explode(F.expr("sequence(1L, (taken + size - 1) div size)")))
    left = F.col("taken") - (F.col("turn") - 1) * F.col("size")
    words = F.slice(F.regexp_extract_all(F.col("doc.text"), F.lit(WORD), F.lit(0)), F.lit(1), left.cast("int"))
    cut = F.when(left >= F.col("size"), F.col("doc.text")).otherwise(F.array_join(words, " "))
    row = F.col("doc").withField("text", F.col("cut"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.length("cut").cast(docs.schema["n_chars"].dataType))
    return got.withColumn("cut", cut).select(row.alias("doc")).select("doc.*")
