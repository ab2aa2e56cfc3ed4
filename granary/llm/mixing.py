"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.common import cut, free_name

WORDS = r"[^\x20\x09-\x0D]+"
#: Up to this many sources their table goes to every task; more are joined by a shuffle.
MAX_BROADCAST_SOURCES = 10_000


def let(value: Column, then) -> Column:
    """then(value), with value computed once."""
    return F.get(F.transform(F.array(value), then), 0)


def apportion(weights: Column, caps: Column, seats: Column, steps: int = 128) -> Column:
    """Sainte-Laguë: the seats of each party, an array<long> beside the arrays weights and caps.

    Giving seats one by one to the highest quotient weight / (2 k + 1) ends where every party holds as many quotients
    as lie above one common value, so that value is found by bisection. Quotients that tie with it go out in order
    of quotient, then of place. Parties stop at their caps; without room for all seats, all caps are filled.
    """
    party = F.zip_with(weights, caps, lambda w, c: F.struct(w.alias("w"), c.alias("c")))

    def above(x: Column, p: Column) -> Column:
        return F.least(p["c"].cast("double"), F.when(p["w"] > 0, F.floor(p["w"] / (2 * x) + 0.5)).otherwise(0).cast("double"))

    def halve(parties: Column, s: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2
        fits = F.aggregate(parties, F.lit(0.0), lambda n, p: n + above(mid, p)) <= seats
        return let(fits, lambda f: F.struct(F.when(f, s["lo"]).otherwise(mid).alias("lo"), F.when(f, mid).otherwise(s["hi"]).alias("hi")))

    def from_value(parties: Column, value: Column) -> Column:
        return let(F.transform(parties, lambda p: F.struct(p["w"].alias("w"), p["c"].alias("c"), above(value, p).alias("a"))), from_base)

    def from_base(held: Column) -> Column:
        left = (seats - F.aggregate(held, F.lit(0.0), lambda n, p: n + p["a"])).cast("int")
        tied = F.filter(F.transform(held, lambda p, i: F.struct(F.when((p["a"] < p["c"]) & (p["w"] > 0), -p["w"] / (2 * p["a"] + 1)).alias("q"), i.alias("i"))), lambda t: t["q"].isNotNull())
        last = let(F.array_sort(tied), lambda t: F.when(left > 0, F.get(t, F.least(left, F.size(t)) - 1)))
        more = lambda p, i, x: (x.isNotNull() & (p["a"] < p["c"]) & (p["w"] > 0) & (F.struct((-p["w"] / (2 * p["a"] + 1)).alias("q"), i.alias("i")) <= x)).cast("double")
        return let(last, lambda x: F.transform(held, lambda p, i: (p["a"] + F.coalesce(more(p, i, x), F.lit(0.0))).cast("long")))

    top = F.aggregate(weights, F.lit(1.0), lambda n, w: n + w) * 2
    bisected = lambda parties: F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(F.lit(0.0).alias("lo"), top.alias("hi")), lambda s, _: halve(parties, s))["hi"]
    return let(party, lambda parties: let(bisected(parties), lambda value: from_value(parties, value)))


def source_targets(sources: DataFrame, weights: list[float], budget: float = 1.5, most: float = 2.0) -> DataFrame:
    """sources (source, source_size) with place, weight and target.

    Weights repeat along the sources in code point order, null last. Targets share budget times all sizes by weight
    and stop at most times a source's size; the excess is reshared by weight. In closed form: sources by rising
    ratio of stop to weight are full as long as the level of what is left lies above that ratio.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.lit([float(x) for x in weights]), (F.pmod(F.col("place"), F.lit(len(weights))) + 1).cast("int"))
    stop = most * F.col("source_size")
    by_ratio = Window.orderBy("_ratio", "place")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    total = Window.partitionBy()
    level = (budget * F.sum("source_size").over(total) - F.coalesce(F.sum(stop).over(before), F.lit(0.0))) / (F.sum("weight").over(total) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    full = F.col("_ratio") <= F.col("_level")
    placed = sources.withColumn("place", F.row_number().over(by_name) - 1).withColumn("weight", w).withColumn("_ratio", stop / F.col("weight")).withColumn("_level", level)
    last = F.min(F.when(~full, F.struct("_ratio", "place", "_level"))).over(total)["_level"]
    return (
        placed.withColumn("_last", last)
        .withColumn("target", F.when(full, stop).otherwise(F.least(stop, F.col("weight") * F.col("_last"))))
        .drop("_level", "_ratio", "_last")
    )


def mix_plan(docs: DataFrame, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id", weights: tuple[float, ...] = (5, 2, 1), budget: float = 1.5, most: int = 2, block_words: int = 16, shard_words: int = 500_000, max_shards: int = 50_000, seed: int = 17) -> DataFrame:
    """For every row of docs: _row (its place), id_col, size, source_size, target, taken.

    size: words of the text, null and empty: none. A source's documents, in an order seeded by id and text, form
    shards of about shard_words words (more if there would be more than max_shards in all); each shard is a stream
    of words cut into blocks of block_words. Sainte-Laguë gives whole blocks first to sources by target, then to a
    source's shards by size, each block `most` times at most. A shard takes a run of its blocks, as many as its
    quota, around the end from a seeded start, so that only documents at the ends of the run are cut; taken counts
    the words of a document in taken blocks, with repeats. Sources without words have target 0. Rows of one id
    and text share out what they take in either order. A very long text counts with all its words and may make up
    a shard of its own. An empty table gives an empty result.

    The text is read once; all later steps use a narrow table in the checkpoint folder. No task holds more than a
    shard, however large a source is; quotas are one row for each source. docs must yield the same rows in the same
    order when read again.
    """
    draw = lambda k, *more: F.xxhash64(F.lit(seed + k), *more)
    narrow = cut(
        docs.select(
            F.monotonically_increasing_id().alias("_row"),
            F.col(source_col).alias("source"),
            F.col(id_col).alias("_id"),
            F.coalesce(F.regexp_count(text_col, F.lit(WORDS)), F.lit(0)).cast("long").alias("size"),
            F.xxhash64(F.lit(seed), id_col, text_col).alias("_key"),
        )
    )
    sizes = cut(narrow.groupBy("source").agg(F.sum("size").alias("source_size")))
    n_sources, total = sizes.agg(F.count(F.lit(1)), F.coalesce(F.sum("source_size"), F.lit(0))).first()
    per_shard = max(shard_words, total // max_shards)

    blocks = lambda words: F.ceil(words / block_words).cast("long")
    targets = cut(source_targets(sizes, list(weights), budget, most))
    everyone = targets.agg(F.array_sort(F.collect_list(F.struct("place", "target", "source_size"))).alias("each"), F.round(F.sum("target") / block_words).alias("seats"))
    quota = apportion(F.col("each.target"), F.transform("each.source_size", lambda n: most * blocks(n)), F.col("seats"))
    quotas = everyone.select(F.posexplode(quota).alias("_at", "_blocks"))
    sources = cut(
        targets.join(quotas, F.col("place") == F.col("_at")).select(
            F.col("source").alias("_source"), "place", "source_size", "target", "_blocks", F.greatest(F.lit(1), F.ceil(F.col("source_size") / per_shard)).cast("int").alias("_shards")
        )
    )
    sent = F.broadcast(sources) if n_sources <= MAX_BROADCAST_SOURCES else sources
    dealt = narrow.join(sent, F.col("source").eqNullSafe(F.col("_source"))).withColumn("_shard", F.pmod(draw(1, "_key"), F.col("_shards")).cast("int"))

    cells = dealt.groupBy("place", "_shard").agg(F.sum("size").alias("_cell"), F.first("_blocks").alias("_blocks"))
    listed = cells.groupBy("place").agg(F.array_sort(F.collect_list(F.struct("_shard", "_cell"))).alias("_cells"), F.first("_blocks").alias("_blocks"))
    quota = apportion(F.transform("_cells", lambda c: c["_cell"].cast("double")), F.transform("_cells", lambda c: most * blocks(c["_cell"])), F.col("_blocks").cast("double"))
    quotas = listed.select("place", F.posexplode(quota).alias("_i", "_quota"), "_cells").select(F.col("place").alias("_p"), F.get("_cells", F.col("_i"))["_shard"].alias("_k"), F.get("_cells", F.col("_i"))["_cell"].alias("_cell"), "_quota")

    stream = Window.partitionBy("place", "_shard").orderBy("_key", "_id", "_row")
    placed = dealt.withColumn("_end", F.sum("size").over(stream)).join(quotas, (F.col("place") == F.col("_p")) & (F.col("_shard") == F.col("_k")))
    n = F.greatest(blocks(F.col("_cell")), F.lit(1).cast("long"))
    passes, run = F.floor(F.col("_quota") / n).cast("long"), F.col("_quota") % n
    start = F.pmod(draw(2, "place", "_shard"), n)
    inside = lambda x, most_of: F.least(F.greatest(x, F.lit(0)), most_of)
    upto = lambda x: passes * x + inside(x - start * block_words, run * block_words) + inside(x, F.greatest(start + run - n, F.lit(0)) * block_words)
    taken = (upto(F.col("_end")) - upto(F.col("_end") - F.col("size"))).cast("long")
    return placed.select("_row", F.col("_id").alias(id_col), "size", "source_size", "target", taken.alias("taken"))


def mix(docs: DataFrame, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id", **how) -> DataFrame:
    """docs as the mix takes them: every row as often as mix_plan takes it, to the nearest whole number.

    All columns of docs, of whatever names, stay as they were; a row that is cut at the end of a run counts from half
    of its words on.
    """
    row, plan = free_name(docs, "_row"), mix_plan(docs, text_col, source_col, id_col, **how)
    times = F.floor(F.col("taken") / F.col("size") + 0.5).cast("int")
    times = plan.filter("size > 0").select(F.col("_row").alias(row), times.alias(free_name(docs, "_times"))).filter(F.col(free_name(docs, "_times")) > 0)
    columns = [f"`{c}`" for c in docs.columns]
    return docs.withColumn(row, F.monotonically_increasing_id()).join(times, row).select(*columns, F.explode(F.array_repeat(F.lit(1), F.col(free_name(docs, "_times")))).alias(free_name(docs, "_copy"))).select(*columns)
