"""Result lists made readable: hits that lie near each other as one group, and chips that narrow a result set."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.session import ship_package, written

#: Lines that may lie between two hits of one group, and levels of chunks above each other: document, section, paragraph.
GAP, LEVELS = 3, 2
#: Chips at most; the share of the results that a chip may leave at most; results from which there are chips at all.
CHIPS, MOST_LEFT, LEAST_RESULTS = 3, 0.8, 4
#: Results whose places one long holds as bits.
WORD = 63
#: Ranks of a query that one task numbers together.
RANKS = 1 << 16


def numbered(rows: DataFrame, part: Column, order: list[Column | str], name: str) -> DataFrame:
    """``rows`` with the place of each among its query's, from 1, as column ``name``; they are read twice.

    ``part`` splits a query's rows by ranges of ``order``: a part is sorted by itself and starts behind the rows of the parts before it, so no task sorts all rows of a query.
    """
    rows = rows.withColumn("_part", part)
    before = Window.partitionBy("query_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("query_id", "_part").agg(F.count("*").alias("_n"))
    starts = sizes.select(F.col("query_id").alias("_query"), F.col("_part").alias("_own"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = rows.withColumn(name, F.row_number().over(Window.partitionBy("query_id", "_part").orderBy(*order)))
    met = own.join(starts, F.col("query_id").eqNullSafe(F.col("_query")) & F.col("_part").eqNullSafe(F.col("_own")))
    return met.withColumn(name, (F.col(name) + F.col("_start")).cast("int")).drop("_part", "_query", "_own", "_start")


def folded(hits: DataFrame, levels: int = LEVELS) -> DataFrame:
    """``hits`` without those whose child chunk is a hit of the same query: a parent's rank, if better, goes to its best child.

    ``hits`` has query_id, chunk_id, parent_chunk_id and rank; a chunk that is there twice counts once, with its best rank. Chunks are folded from the top: a
    document into its section and that into its paragraph. Of equally ranked children the smallest chunk_id counts.
    """
    others = [c for c in hits.columns if c not in ("query_id", "chunk_id", "rank")]
    rows = hits.groupBy("query_id", "chunk_id").agg(F.min(F.struct("rank", *others)).alias("h")).select("query_id", "chunk_id", "h.*").withColumn("folded", F.lit(0).cast("bigint"))
    for _ in range(levels):
        # a level reads the rows several times
        rows = written(rows, "rows")
        # a chunk meets its children where its own row and theirs have one key
        own = rows.select("query_id", F.col("chunk_id").alias("key"), F.lit(True).alias("self"), "chunk_id", "parent_chunk_id", "rank", "folded")
        child = rows.where("parent_chunk_id is not null").select("query_id", F.col("parent_chunk_id").alias("key"), F.lit(False).alias("self"), "chunk_id", "parent_chunk_id", "rank", "folded")
        met = written(own.unionByName(child).groupBy("query_id", "key").agg(
            F.min(F.when(F.col("self"), F.struct("rank", "folded", "parent_chunk_id"))).alias("top"), F.min(F.when(~F.col("self"), F.struct("rank", "chunk_id"))).alias("heir")
        ).where("top is not null and heir is not null"), "parents")
        if met.isEmpty():
            break
        # parents whose own parent is a hit too wait for the next level, which has no others
        last = met.where("top.parent_chunk_id is not null").isEmpty()
        if not last:
            above = rows.select("query_id", F.col("chunk_id").alias("_above"))
            met = met.join(above, (met.query_id == above.query_id) & (F.col("top.parent_chunk_id") == F.col("_above")), "left_anti")
        given = met.select("query_id", F.explode(F.array(
            F.struct(F.col("heir.chunk_id").alias("chunk_id"), F.col("top.rank").alias("_rank"), (F.col("top.folded") + 1).alias("_folded"), F.lit(False).alias("_gone")),
            F.struct(F.col("key").alias("chunk_id"), F.lit(None).cast("int").alias("_rank"), F.lit(0).cast("bigint").alias("_folded"), F.lit(True).alias("_gone")),
        )).alias("g")).select("query_id", "g.*")
        given = given.groupBy("query_id", "chunk_id").agg(F.min("_rank").alias("_rank"), F.sum("_folded").alias("_folded"), F.bool_or("_gone").alias("_gone"))
        rows = rows.join(given, ["query_id", "chunk_id"], "left").where(~F.coalesce("_gone", F.lit(False)))
        rows = rows.withColumn("rank", F.least("rank", "_rank")).withColumn("folded", F.col("folded") + F.coalesce("_folded", F.lit(0).cast("bigint"))).drop("_rank", "_folded", "_gone")
        if last:
            break
    return rows


def nearby(hits: DataFrame, gap: int = GAP, levels: int = LEVELS) -> DataFrame:
    """(query_id, group_rank, file_id, line_start, line_end, chunk_id, rank, additional_hits): groups of hits of one file with at most ``gap`` lines between them.

    ``hits`` has query_id, chunk_id, parent_chunk_id, file_id, line_start, line_end and rank. Parents are folded into children first; a group has the best rank of its hits, and the
    chunk of that rank (the smallest chunk_id of several) speaks for it; the others are its additional hits. A list may be as long as the corpus: files part its hits, and ranks its groups.
    """
    rows = folded(hits, levels)
    order = Window.partitionBy("query_id", "file_id").orderBy("line_start", "line_end", "chunk_id")
    reach = F.max("line_end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_new", F.coalesce((F.col("line_start") > reach + gap + 1).cast("int"), F.lit(1)))
    rows = rows.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    groups = rows.groupBy("query_id", "file_id", "_island").agg(
        F.min("line_start").alias("line_start"), F.max("line_end").alias("line_end"), F.min(F.struct("rank", "chunk_id")).alias("best"), (F.count("*") + F.sum("folded") - 1).alias("additional_hits")
    )
    named = groups.select("query_id", "file_id", "line_start", "line_end", F.col("best.chunk_id").alias("chunk_id"), F.col("best.rank").alias("rank"), "additional_hits")
    out = numbered(written(named, "groups"), F.floor(F.col("rank") / RANKS), ["rank", "chunk_id"], "group_rank")
    return out.select("query_id", "group_rank", "file_id", "line_start", "line_end", "chunk_id", "rank", "additional_hits")


def chips(results: DataFrame, facets: list[str], most: int = CHIPS, most_left: float = MOST_LEFT, least: int = LEAST_RESULTS) -> DataFrame:
    """(query_id, place, facet, value, n, fresh): up to ``most`` chips of each query's results, which have a ``rank`` from 1.

    A chip leaves some results and at most ``most_left`` of them. The first is the one that leaves most; each next one is that with most results which no chip before it has
    (``fresh``), so chips do not say the same twice; one without such results is not shown. Null values make no chip, and queries with fewer than ``least``
    results none at all. Places of results are bits, a long for ``WORD`` of them; ties go to the facet and value that come first.
    """
    pairs = F.array(*[F.struct(F.lit(f).alias("facet"), F.col(f).cast("string").alias("value")) for f in facets])
    word, bit = F.floor((F.col("rank") - 1) / WORD).cast("int"), F.pmod(F.col("rank") - 1, F.lit(WORD)).cast("int")
    rows = results.select("query_id", word.alias("word"), F.call_function("shiftleft", F.lit(1).cast("bigint"), bit).alias("one"), F.explode(pairs).alias("p")).where("p.value is not null")
    bits = rows.groupBy("query_id", "p.facet", "p.value", "word").agg(F.bit_or("one").alias("bits"))
    total = results.groupBy("query_id").agg(F.count("*").alias("total")).where(F.col("total") >= least)
    counted = bits.withColumn("n", F.sum(F.bit_count("bits")).over(Window.partitionBy("query_id", "facet", "value")))
    left = counted.join(total, "query_id").where(F.col("n") <= most_left * F.col("total")).select("query_id", "facet", "value", "word", "bits", "n")
    ship_package(results.sparkSession)

    def pick(own: pd.DataFrame) -> pd.DataFrame:
        """Greedy choice over the bitmaps of one query: some for each facet's values among its results."""
        maps: dict[tuple[str, str], int] = {}
        for facet, value, word, part in zip(own["facet"], own["value"], own["word"], own["bits"]):
            maps[facet, value] = maps.get((facet, value), 0) | int(part) << (WORD * int(word))
        seen, out = 0, []
        while maps and len(out) < most:
            (facet, value), bits = min(maps.items(), key=lambda m: (-(m[1] & ~seen).bit_count(), m[0]))
            if not (fresh := (bits & ~seen).bit_count()):
                break
            out.append((own["query_id"].iloc[0], len(out) + 1, facet, value, bits.bit_count(), fresh))
            seen |= bits
        return pd.DataFrame(out, columns=["query_id", "place", "facet", "value", "n", "fresh"])

    kind = results.schema["query_id"].dataType.simpleString()
    return left.groupBy("query_id").applyInPandas(pick, f"query_id {kind}, place int, facet string, value string, n bigint, fresh bigint")
