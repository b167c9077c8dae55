"""Mixing sources to target weights: exact block quotas, split among shards by a multivariate-hypergeometric tree.

Each source's documents are put in a hashed order and cut into blocks of equally many words.  A quota says how many blocks the
mix draws from each source.  The tree halves the shards again and again; at each node the blocks that go left are a random subset
of the node's, so their numbers by source are a multivariate-hypergeometric draw and the quotas stay exact.  A shard draws
its numbers of blocks from disjoint stretches of the permuted blocks and shuffles them locally.  All of it is DataFrame and SQL functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import ordered, written

#: Blocks of the whole corpus, about; a block has MIN_BLOCK to MAX_BLOCK words.
BLOCKS = 1 << 16
MIN_BLOCK, MAX_BLOCK = 16, 1 << 22
#: Blocks of a shard, about.
SHARD_BLOCKS = 4096
#: Sources up to which their table is broadcast (a row each); beyond it is joined by sorting.
BROADCAST_SOURCES = 100_000
#: Documents that are put in order at once, about.
ORDER_ROWS = 2_000
#: Sources whose quotas are in one row of the tree.
CHUNK = 256
_PRIME = 2654435761


def size_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(k, source, docs, source_size, target) for each source of sizes (source, size).

    Sources by code point, null last, have the weights in turn.  They share `share` times all words by weight; a target stops
    at `most` times its source's words and the rest is shared again by weight, until none is above.  That is min(most * size,
    level * weight) for one level: with sources by size over weight, the largest of the levels that follow from having the
    first 0, 1, 2, ... of them at their stop.
    """
    stats = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("size").alias("source_size"))
    cycle = ", ".join(f"{float(w)}D" for w in weights)
    stats = stats.withColumn("k", F.expr("row_number() OVER (ORDER BY source ASC NULLS LAST)").cast("bigint"))
    stats = stats.withColumn("w", F.expr(f"element_at(array({cycle}), cast((k - 1) % {len(weights)} + 1 AS int))"))
    up = "ORDER BY source_size / w, k"
    stats = stats.withColumn(
        "level",
        F.expr(
            f"""({share}D * sum(source_size) OVER () - coalesce(sum({most}D * source_size) OVER ({up} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0D))
            / sum(w) OVER ({up} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"""
        ),
    )
    return stats.withColumn("target", F.expr(f"least({most}D * source_size, max(level) OVER () * w)")).select("k", "source", "docs", "source_size", "target")


def _halved(level: int, seed: int, free: str) -> str:
    """SQL for the numbers, by entry of counts, of the node's blocks that go left, `free` in all: each block in turn is taken with probability
    (places left to fill) / (blocks left), which is drawing without replacement."""
    chance = f"pmod(xxhash64({seed}L, {level}, chunk, node, s.j, i), 9007199254740992L) / 9007199254740992D"
    inner = f"""aggregate(CASE WHEN c > 0 THEN sequence(1L, c) ELSE cast(array() AS array<bigint>) END,
        named_struct('n', s.n, 'free', s.free, 'x', 0L),
        (t, i) -> CASE WHEN {chance} * t.n < t.free THEN named_struct('n', t.n - 1L, 'free', t.free - 1L, 'x', t.x + 1L) ELSE named_struct('n', t.n - 1L, 'free', t.free, 'x', t.x) END,
        t -> named_struct('n', t.n, 'free', t.free, 'j', s.j + 1L, 'left', concat(s.left, array(t.x))))"""
    start = f"named_struct('n', aggregate(counts, 0L, (a, c) -> a + c), 'free', {free}, 'j', 0L, 'left', cast(array() AS array<bigint>))"
    return f"aggregate(counts, {start}, (s, c) -> {inner}, s -> s.left)"


def _tree(nodes: DataFrame, depth: int, seed: int) -> DataFrame:
    """(chunk, node, counts) at the leaves, from (chunk, node, counts, leaves): leaves are the sums that the 2^depth nodes below must have."""
    for level in range(depth):
        half = 1 << (depth - level - 1)
        nodes = nodes.withColumn("left", F.expr(_halved(level, seed, f"aggregate(slice(leaves, 1, {half}), 0L, (a, c) -> a + c)")))
        both = f"""array(named_struct('node', node * 2L, 'counts', left, 'leaves', slice(leaves, 1, {half})),
            named_struct('node', node * 2L + 1L, 'counts', zip_with(counts, left, (c, l) -> c - l), 'leaves', slice(leaves, {half + 1}, {half})))"""
        nodes = nodes.select("chunk", F.explode(F.expr(both)).alias("x")).select("chunk", "x.*")
    return nodes.select("chunk", "node", "counts")


def split(quotas: DataFrame, depth: int, seed: int = 1) -> DataFrame:
    """(shard, k, drawn, before) from quotas (k, quota), k = 1, 2, ...: how many of a source's draws each of 2^depth shards has,
    and how many the shards before it.  Shards have equally many draws, give or take one for each level.

    A tree splits the draws of CHUNK sources at a time as one; then each chunk has a tree of its own, in which as many go left at a
    node as the first tree says.  That is the same draw, in rows that don't grow with the number of sources.
    """
    listed = quotas.withColumn("chunk", F.expr(f"(k - 1) div {CHUNK}"))
    chunks = listed.groupBy("chunk").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "quota"))), lambda y: y["quota"]).alias("counts"))
    chunks = chunks.withColumn("n", F.expr("aggregate(counts, 0L, (a, c) -> a + c)"))
    top = chunks.agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "n"))), lambda y: y["n"]).alias("counts"))
    top = top.select(F.lit(-1).cast("bigint").alias("chunk"), F.lit(0).cast("bigint").alias("node"), "counts", F.expr("array(aggregate(counts, 0L, (a, c) -> a + c))").alias("leaves"))
    for _ in range(depth):
        top = top.withColumn("leaves", F.expr("flatten(transform(leaves, x -> array(x div 2L, x - x div 2L)))"))
    leaves = _tree(top, depth, seed).select("node", F.posexplode("counts").alias("chunk", "n")).groupBy(F.col("chunk").cast("bigint").alias("chunk"))
    leaves = leaves.agg(F.transform(F.array_sort(F.collect_list(F.struct("node", "n"))), lambda y: y["n"]).alias("leaves"))
    nodes = chunks.join(leaves.hint("shuffle_hash"), "chunk").select("chunk", F.lit(0).cast("bigint").alias("node"), "counts", "leaves")
    out = _tree(nodes, depth, seed).select(F.col("node").alias("shard"), "chunk", F.posexplode("counts").alias("j", "drawn")).select("shard", F.expr(f"chunk * {CHUNK}L + j + 1L").alias("k"), "drawn")
    return out.withColumn("before", F.expr("coalesce(sum(drawn) OVER (PARTITION BY k ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L)"))


def _numbered(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(_row, id, source, text) for each row: the one table in which numbers and texts belong together."""
    rows, _ = ordered(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(text_col).alias("text")), "id", "source", "text")
    return rows.select(F.col("_ord").alias("_row"), "id", "source", "text")


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> tuple[DataFrame, DataFrame]:
    """The documents with their targets, and the mix.

    Documents: (_row, id_col, source_col, size, source_size, target), one for each row of docs; _row is its place in the order of
    ids.  The mix: (shard, slot, _row, id_col, first_word, n_words, place), the pieces of documents it takes, a document's
    pieces at most `most` times over: sorted by slot and place, a shard's pieces are in their shuffled order.

    Sizes are counts of [^\\x20\\x09-\\x0D]+; a null text has none, and a text without words is in no piece.  A null source is
    a source of its own, after the others.  Rows of equal ids are rows of their own.  An empty table gives empty results.
    Words taken from a source are its target, rounded.
    """
    return _mix(_numbered(docs, id_col, text_col, source_col), id_col, source_col, **how)


def _mix(texts: DataFrame, id_col: str, source_col: str, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    rows = written(texts.select("_row", "id", "source", size_of(F.col("text")).alias("size")), "sizes")
    goal = written(targets(rows, weights, share, most), "targets")
    seen = goal.agg(F.count(F.lit(1)).alias("n"), F.sum("source_size").alias("size"), F.sum("target").alias("target")).first()
    w = min(MAX_BLOCK, max(MIN_BLOCK, (seen["size"] or 0) // BLOCKS))
    depth = max(2, (int((seen["target"] or 0) / w / SHARD_BLOCKS)).bit_length())

    # draws d = 0, 1, ... of a source: all its blocks, permuted, once for each whole pass, and the first of them once more
    plan = goal.withColumn("words", F.expr("cast(round(target) AS bigint)")).withColumn("blocks", F.expr(f"ceil(source_size / {w})"))
    plan = plan.withColumn("passes", F.expr("CASE WHEN source_size > 0 THEN words div source_size ELSE 0L END"))
    plan = plan.withColumn("quota", F.expr(f"passes * blocks + cast(ceil((words - passes * source_size) / {w}) AS bigint)"))
    shards = split(plan.select("k", "quota"), depth, seed)
    draws = shards.filter("drawn > 0").withColumn("d", F.explode(F.expr("sequence(before, before + drawn - 1L)"))).select("shard", "k", "d")
    small = seen["n"] <= BROADCAST_SOURCES
    draws = draws.join(F.broadcast(plan) if small else plan.hint("shuffle_hash"), "k").withColumn("pass", F.expr("d div blocks")).withColumn("j", F.expr("d % blocks"))
    # full blocks change places, the last and shorter one stays the last of its pass
    draws = draws.withColumn("block", F.expr(f"CASE WHEN j = blocks - 1L THEN j ELSE (j * {_PRIME}L + pmod(xxhash64({seed}L, k, pass), blocks - 1L)) % (blocks - 1L) END"))
    draws = draws.withColumn("n", F.expr(f"least({w}L, source_size - block * {w}L, words - pass * source_size - j * {w}L)"))
    draws = draws.select("shard", "k", "d", "block", "n")

    placed = rows.join(F.broadcast(goal) if small else goal.hint("merge"), rows["source"].eqNullSafe(goal["source"])).drop(goal["source"])
    placed = placed.withColumn("h", F.xxhash64(F.lit(seed), "id", "size")).withColumn("part", F.expr(f"pmod(h, greatest(1L, docs div {ORDER_ROWS}L))"))
    sums = placed.groupBy("k", "part").agg(F.sum("size").alias("s"))
    sums = sums.withColumn("base", F.expr("coalesce(sum(s) OVER (PARTITION BY k ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L)")).select("k", "part", "base")
    placed = placed.withColumn("own", F.expr("coalesce(sum(size) OVER (PARTITION BY k, part ORDER BY h, id, _row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L)"))
    placed = placed.join(sums.hint("shuffle_hash"), ["k", "part"]).withColumn("start", F.expr("base + own"))
    pieces = placed.filter("size > 0").withColumn("block", F.explode(F.expr(f"sequence(start div {w}L, (start + size - 1L) div {w}L)")))
    pieces = pieces.select("_row", "id", "size", "start", "k", "block").join(draws.hint("shuffle_hash"), ["k", "block"])
    pieces = pieces.withColumn("lo", F.expr(f"greatest(start, block * {w}L)")).withColumn("hi", F.expr(f"least(start + size, block * {w}L + n)")).filter("lo < hi")
    pieces = pieces.select("shard", F.xxhash64(F.lit(seed + 1), "k", "d").alias("slot"), "_row", F.col("id").alias(id_col), F.expr("lo - start").alias("first_word"), F.expr("hi - lo").alias("n_words"), F.col("start").alias("place"))
    out = rows.join(F.broadcast(goal) if small else goal.hint("merge"), rows["source"].eqNullSafe(goal["source"])).select("_row", F.col("id").alias(id_col), rows["source"].alias(source_col), "size", "source_size", "target")
    return out, pieces


def with_pieces(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """(id_col, source_col, size, source_size, target, taken, pieces, text_col) for each row of docs, in the order of ids.

    pieces is an array of (shard, slot, place, first_word, n_words), sorted: which words of the text each shard takes, and where they
    stand in the shard's shuffled order.  taken is their sum, 0 for a text that the mix doesn't take.

    Rows of equal or null ids are rows of their own and keep their own texts; null texts stay null, with size 0; a null source is a source; an empty
    table gives an empty result; other columns, whatever their names, aren't looked at.
    """
    texts = _numbered(docs, id_col, text_col, source_col)
    rows, pieces = _mix(texts, id_col, source_col, **how)
    took = pieces.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("shard", "slot", "place", "first_word", "n_words"))).alias("pieces"))
    out = rows.join(took.hint("shuffle_hash"), "_row", "left").withColumn("pieces", F.coalesce("pieces", F.expr("cast(array() AS array<struct<shard:bigint,slot:bigint,place:bigint,first_word:bigint,n_words:bigint>>)")))
    out = out.withColumn("taken", F.expr("aggregate(pieces, 0L, (a, x) -> a + x.n_words)"))
    joined = texts.select("_row", F.col("text").alias(text_col)).join(out.hint("shuffle_hash"), "_row")
    return joined.select(id_col, source_col, "size", "source_size", "target", "taken", "pieces", text_col)


def written_mix(mixed: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the result of with_pieces() as Parquet files of (shard, slot, place, id_col, text_col), a row for each piece, with the words and
    blanks of the text that it takes.  Files are ranges of (shard, slot): one after the other, they hold each shard in its shuffled order, and none grows with
    a shard.  Rows of equal or null ids stay apart; a null text has no pieces; an empty table gives no rows."""
    one = mixed.select(id_col, F.col(text_col).alias("_text"), "size", F.explode("pieces").alias("_p"))
    words = F.split("_text", "(?<=[\\x20\\x09-\\x0D])(?=[^\\x20\\x09-\\x0D])")
    lead = F.when(F.col("_text").rlike("^[\\x20\\x09-\\x0D]"), 1).otherwise(0)  # blanks before the first word
    part = F.array_join(F.slice(words, (F.col("_p.first_word") + lead + 1).cast("int"), F.col("_p.n_words").cast("int")), "")
    text = F.when(F.col("_p.n_words") == F.col("size"), F.col("_text")).otherwise(part)
    out = one.select("_p.shard", "_p.slot", "_p.place", id_col, text.alias(text_col))
    n = max(int(mixed.sparkSession.conf.get("spark.sql.shuffle.partitions")), 12)
    out.repartitionByRange(n, "shard", "slot").sortWithinPartitions("shard", "slot", "place").write.parquet(path)


def taken(docs: DataFrame, **how) -> DataFrame:
    """(id_col, source_col, size, source_size, target, taken, pieces, shards) for each row of docs: the words that the mix takes of it, repeats counted, and
    in how many pieces and different shards."""
    rows, pieces = mix(docs, **how)
    took = pieces.groupBy("_row").agg(F.sum("n_words").alias("taken"), F.count(F.lit(1)).alias("pieces"), F.size(F.collect_set("shard")).cast("bigint").alias("shards"))
    out = rows.join(took.hint("shuffle_hash"), "_row", "left")
    return out.select(*rows.columns, *(F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("taken", "pieces", "shards"))).drop("_row")
