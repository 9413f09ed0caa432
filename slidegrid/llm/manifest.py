"""Merkle manifests: leaves in order of id by ranks in merged bitmaps, trees by keyed slots, proofs from above."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slidegrid.llm.common import checkpointed, quoted

#: Nodes that become one node, and the nodes of two levels that one row holds.
FAN, SLOTS = 8, 64
#: Bits of an id that pick a bit of a word, a word of a container, and a child in each level of the directory above.
BIT, WORD, LEVEL = 6, 4, 14
#: Word of null ids, below all others, so that they come first.
NULLS = -(1 << 58)
LAST = (1 << 33) - 1
ASCII_UP, ASCII_LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEP_TYPE = "array<struct<l:string,r:string>>"


def digest(values: list[Column]) -> Column:
    """SHA-256 of the values, each with its length in bytes before it; `-` for null."""
    parts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in parts]), 256)


def lowered(text: Column) -> Column:
    """The text with A-Z, and no other letters, in lower case."""
    return F.translate(text.cast("string"), ASCII_UP, ASCII_LOW)


def leaves(docs: DataFrame, fields: tuple[str, ...], id_col: str, group_col: str, text_col: str, tampered: Column, tamper) -> DataFrame:
    """g, id, word, bit, leaf, other: every row's group, id, the id's bit in the bitmaps, and digests of the row and of the tampered row."""
    of = lambda changed: digest([changed(F.col(quoted(x))) if x == text_col else F.col(quoted(x)) for x in fields])
    id_ = F.col(quoted(id_col)).cast("bigint")
    return docs.select(
        F.coalesce(F.concat(F.lit("="), F.col(quoted(group_col)).cast("string")), F.lit("-")).alias("g"), id_.alias("id"),
        F.coalesce(F.shiftright(id_, BIT), F.lit(NULLS)).alias("word"), F.coalesce(id_.bitwiseAND(F.lit(63)), F.lit(0)).cast("int").alias("bit"),
        F.unhex(of(lambda x: x)).alias("leaf"), F.when(tampered, F.unhex(of(tamper))).alias("other"),
    )


def _below(bits: str, bit: str) -> Column:
    return F.bit_count(F.expr(f"{bits} & ~shiftleft(-1L, {bit})"))


def directory(words: DataFrame) -> DataFrame:
    """g, c, held, size: the words of each container of 1,024 ids with the number of rows before each, and the group's rows.

    words has g, word, bits, n and extra. Containers have a tree of counts above them, of at most 2**14 children a node,
    so no window holds more rows than that, however the ids are spread.
    """
    held = F.array_sort(F.collect_list(F.struct(F.expr(f"CAST(word & {(1 << WORD) - 1} AS INT)").alias("w"), "bits", "n", "extra")))
    levels = [checkpointed(words.groupBy("g", F.shiftright("word", WORD).alias("c")).agg(held.alias("held"), F.sum("n").alias("total")))]
    for _ in range(3):
        levels.append(levels[-1].groupBy("g", F.shiftright("c", LEVEL).alias("c")).agg(F.sum("total").alias("total")))
    size = levels[-1].groupBy("g").agg(F.sum("total").alias("size"))
    above = levels[-1].join(size, "g").withColumn("before", F.sum("total").over(Window.partitionBy("g").orderBy("c")) - F.col("total"))
    for below in reversed(levels[:-1]):
        up = above.select("g", F.col("c").alias("up"), F.col("before").alias("base"), "size")
        in_node = F.sum("total").over(Window.partitionBy("g", "up").orderBy("c")) - F.col("total")
        above = below.withColumn("up", F.shiftright("c", LEVEL)).join(up, ["g", "up"]).withColumn("before", F.col("base") + in_node)
    run = F.transform("held", lambda x, i: F.struct(x["w"].alias("w"), x["bits"].alias("bits"), x["extra"].alias("extra"), (F.col("before") + F.aggregate(F.slice("held", 1, i), F.lit(0).cast("bigint"), lambda a, y: a + y["n"])).alias("first")))
    return above.select("g", "c", run.alias("held"), "size")


def ranked(rows: DataFrame, table: DataFrame) -> DataFrame:
    """rows with `i`, the number of rows of the group with smaller ids, and the group's size."""
    at = rows.withColumn("c", F.shiftright("word", WORD)).join(table, ["g", "c"])
    at = at.withColumn("one", F.element_at(F.filter("held", lambda x: x["w"] == F.expr(f"CAST(word & {(1 << WORD) - 1} AS INT)")), 1))
    more = F.aggregate(F.filter("one.extra", lambda x: x["bit"] < F.col("bit")), F.lit(0).cast("bigint"), lambda a, x: a + x["more"])
    return at.withColumn("i", F.col("one.first") + _below("one.bits", "bit") + F.coalesce(more, F.lit(0))).drop("c", "held", "one")


def with_ranks(rows: DataFrame) -> DataFrame:
    """g, i, size, id, leaf, other: rows with their places among those of their group, by id; rows with one id go by their leaves.

    Partial bitmaps, one 64-bit word for 64 ids that occur, are merged by or; a rank is a count of rows before the
    container and the word, and of the bits before the id's. Only ids that occur more than once are grouped by id.
    """
    words = checkpointed(rows.groupBy("g", "word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"), F.count("*").alias("n")))
    repeated = words.where(F.col("n") > F.bit_count("bits")).select("g", "word")
    none = F.expr("CAST(array() AS array<struct<bit:int,more:bigint>>)")
    if repeated.isEmpty():
        return ranked(rows, directory(words.withColumn("extra", none))).drop("word", "bit")
    key = ["g", "word", "bit"]
    same = checkpointed(rows.join(repeated, ["g", "word"], "left_semi").groupBy(*key, "id", "leaf").agg(F.first("other").alias("other"), F.count("*").alias("m")).withColumn("part", F.substring("leaf", 1, 2)))
    more = same.groupBy(*key).agg((F.sum("m") - 1).alias("more")).where("more > 0").groupBy("g", "word").agg(F.collect_list(F.struct("bit", "more")).alias("extra"))
    table = directory(words.join(more, ["g", "word"], "left").withColumn("extra", F.coalesce("extra", none)))
    # leaves of one id are dealt by their first bytes, so an id that very many rows have is no single group
    before = lambda n, w: F.sum(n).over(w) - F.col(n)
    parts = same.groupBy(*key, "part").agg(F.sum("m").alias("n")).withColumn("start", before("n", Window.partitionBy(*key).orderBy("part"))).drop("n")
    placed = same.join(parts, [*key, "part"]).withColumn("start", F.col("start") + before("m", Window.partitionBy(*key, "part").orderBy("leaf")))
    placed = ranked(placed, table).withColumn("i", F.col("i") + F.col("start"))
    kept = ["g", "i", "size", "id", "leaf", "other"]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = placed.select(*kept, "m", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("m") - 1, F.lit(4096).cast("bigint"))).alias("from")).repartition(n, "g", "i", "from")
    copies = dealt.withColumn("k", F.explode(F.sequence("from", F.least(F.col("from") + 4095, F.col("m") - 1)))).withColumn("i", F.col("i") + F.col("k"))
    single = rows.join(repeated, ["g", "word"], "left_anti")
    return ranked(single, table).select(*kept).unionByName(copies.select(*kept))


def _joined(nodes: Column, start: Column | int, n: Column | int) -> Column:
    return F.array_join(F.slice(nodes, start if isinstance(start, Column) else F.lit(start), n if isinstance(n, Column) else F.lit(n)), "")


def _up(size: str) -> Column:
    return F.when(F.col(size) > 1, F.expr(f"({size} + {FAN - 1}) DIV {FAN}")).otherwise(F.lit(1)).cast("bigint")


def climbed(nodes: DataFrame, payload: list[str], digests: Column) -> DataFrame:
    """g, chunk, slots, nodes, mid, top and sizes: 64 consecutive nodes a row, keyed by their place, and the two levels above them.

    Of a group with one node the node itself is the top; `size`, `size1` and `size2` count the group's nodes at each level.
    """
    rows = nodes.groupBy("g", F.shiftright("i", 6).alias("chunk")).agg(F.array_sort(F.collect_list(F.struct(F.expr(f"CAST(i & {SLOTS - 1} AS INT)").alias("k"), *payload))).alias("slots"), F.first("size").alias("size"))
    rows = rows.withColumn("nodes", digests)
    runs = F.transform(F.sequence(F.lit(0), F.expr(f"CAST((size(nodes) - 1) DIV {FAN} AS INT)")), lambda k: F.sha2(_joined(F.col("nodes"), k * FAN + 1, FAN), 256))
    rows = rows.withColumn("mid", F.when(F.col("size") > 1, runs).otherwise(F.col("nodes"))).withColumn("size1", _up("size"))
    return checkpointed(rows.withColumn("top", F.when(F.col("size1") > 1, F.sha2(F.array_join("mid", ""), 256)).otherwise(F.col("mid")[0])).withColumn("size2", _up("size1")))


def tree(nodes: DataFrame, payload: list[str], digests: Column, largest: int) -> list[DataFrame]:
    """The rounds of chunks from the leaves to the tops of all groups; a group is in the rounds that it needs."""
    rounds = [climbed(nodes, payload, digests)]
    while (largest := -(-largest // SLOTS)) > 1:
        up = rounds[-1].where("size2 > 1").select("g", F.col("chunk").alias("i"), F.col("size2").alias("size"), F.col("top").alias("node"))
        rounds.append(climbed(up, ["node"], F.transform("slots", lambda x: x["node"])))
    return rounds


def tops(rounds: list[DataFrame]) -> DataFrame:
    """g, round, node: each group's top, and the round in which it is reached."""
    found = [x.where("size2 = 1").select("g", F.lit(i).alias("round"), F.col("top").alias("node")) for i, x in enumerate(rounds)]
    return reduce(DataFrame.union, found)


def _path(k: Column) -> Column:
    """The siblings of the chunk's node k at each level to the top, those on its left and on its right apart."""
    here, run = k % FAN, (k / FAN).cast("int")
    low = F.struct(_joined(F.col("nodes"), k - here + 1, here).alias("l"), _joined(F.col("nodes"), k + 2, F.lit(FAN - 1) - here).alias("r"))
    high = F.struct(_joined(F.col("mid"), 1, run).alias("l"), _joined(F.col("mid"), run + 2, FAN).alias("r"))
    none = F.expr(f"CAST(array() AS {STEP_TYPE})")
    return F.concat(F.when(F.col("size") > 1, F.array(low)).otherwise(none), F.when(F.col("size1") > 1, F.array(high)).otherwise(none), F.col("path"))


def paths(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """Every row of the lowest round as slots with their own paths. above: g, path and what else goes with each group's top.

    From the tops down, a chunk gets the siblings above it and passes them on to its nodes; so only the lowest
    round makes rows for leaves, and those leave their chunks last.
    """
    more = [x for x in above.columns if x not in ("g", "round", "path")]
    ends = above.withColumn("chunk", F.lit(0).cast("bigint"))
    from_above = None
    for i in range(len(rounds) - 1, -1, -1):
        here = ends.where(F.col("round") == i).select("g", "chunk", "path", *more)
        here = here if from_above is None else here.unionByName(from_above)
        rows = rounds[i].join(here, ["g", "chunk"])
        slot = rows.withColumn("slot", F.explode("slots")).withColumn("path", _path(F.col("slot.k")))
        if not i:
            return slot
        from_above = slot.select("g", (F.col("chunk") * SLOTS + F.col("slot.k")).alias("chunk"), "path", *more)


def in_order(rows: DataFrame, key: str) -> DataFrame:
    """rows with `i`, their number in order of the key, which no two rows share."""
    cut = checkpointed(rows.orderBy(key).select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit(LAST)).alias("_at")))
    first = cut.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n"))
    return cut.join(F.broadcast(first.drop("_n")), "_part").withColumn("i", F.col("_at") + F.col("_before")).drop("_part", "_at", "_before")


def manifest(
    docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", group_col: str = "lang", text_col: str = "text", tampered: Column | None = None, tamper=lowered
) -> DataFrame:
    """id, g, leaf, subroot, root, path, folded_root: every row's leaf, the tops over it, and the siblings from leaf to root.

    A leaf is the digest of the row's fields. In each group the leaves stand by id, null ids first and rows of one id by
    leaf; runs of eight become one node until one is left; so do the groups' tops, null first, then by the bytes of
    their names. path has the siblings of each level as two strings, left and right of the node. folded_root is the root
    that follows from the path and the row as `tamper` leaves its text where `tampered` holds (nowhere, if not given).

    Nulls in any field have a digest of their own; empty and long texts are values like others, digested whole; repeated rows are
    leaves each; an empty table gives no rows. Other columns of docs don't count. Rows are shuffled as digests, never as texts.
    """
    rows = checkpointed(leaves(docs, fields, id_col, group_col, text_col, F.lit(False) if tampered is None else tampered, tamper))
    placed = with_ranks(rows)
    largest = rows.groupBy("g").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    rounds = tree(placed, ["id", "leaf", "other"], F.transform("slots", lambda x: F.lower(F.hex(x["leaf"]))), largest)
    groups = checkpointed(tops(rounds))
    n = groups.count()
    over = in_order(groups, "g").select(F.lit("").alias("g"), "i", F.lit(n).cast("bigint").alias("size"), "node", F.col("g").alias("group"), "round")
    high = tree(over, ["node", "group", "round"], F.transform("slots", lambda x: x["node"]), n)
    root = tops(high).withColumnRenamed("node", "root").withColumn("path", F.expr(f"CAST(array() AS {STEP_TYPE})"))
    down = checkpointed(paths(high, root).select(F.col("slot.group").alias("g"), F.col("slot.round").alias("round"), F.col("slot.node").alias("subroot"), "root", "path"))
    held = paths(rounds, down)
    leaf = F.lower(F.hex("slot.leaf"))
    start = F.coalesce(F.lower(F.hex("slot.other")), leaf)
    folded = F.aggregate("path", start, lambda a, x: F.sha2(F.concat(x["l"], a, x["r"]), 256))
    return held.select(F.col("slot.id").alias("id"), "g", leaf.alias("leaf"), "subroot", "root", "path", folded.alias("folded_root"))


def proof(path: Column) -> Column:
    """All siblings of a path, from the leaf's level to the root's, each level left to right."""
    return F.array_join(F.transform(path, lambda x: F.concat(x["l"], x["r"])), "")
