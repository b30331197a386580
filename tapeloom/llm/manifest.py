"""Merkle manifest of a dataset: digests of rows, of groups and of the whole, with a proof for each row.

A row's leaf is the SHA-256 of its fields, each ``-`` if null, else its UTF-8
byte count, ``:`` and its value.  In a group the leaves stand in the order of
``id_col``; while more than one node remains, every ``FAN`` consecutive ones
become the digest of their hex digests laid end to end.  The groups' subroots,
in the order of the group (null first), give the root in the same way.

Leaves are sorted by range and numbered from the counts of each part, so that no
group is sorted in one task.  ``BLOCK`` aligned nodes are one row: each level of
the block is one hex string; fixed-width substrings of it are hashed into the
next level, and the substrings that flank a node are its siblings.  The tops of
the blocks are the nodes of the next round, until each group has one.  Proofs are
made on the way down: a block gets the path above it by a join on blocks, of
which there is one in ``BLOCK`` rows; texts are never shuffled.

Rows with equal ids stand in the order of their leaves; repeated rows are leaves
of their own.  A null id is first and is never changed.  Null and empty texts
differ (``-`` and ``0:``).  Texts of any length are hashed whole; an empty table
gives an empty one.  Other columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm.common import bounded, cut, materialize, read_table

FAN, STEPS = 8, 3
#: Nodes of a row, and hex digits of a digest.
BLOCK, WIDTH = FAN**STEPS, 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf_digest(*fields: Column) -> Column:
    """Hex SHA-256 of the fields, each with its length before it."""

    def part(value: Column) -> Column:
        value = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*map(part, fields)), 256)


def numbered(rows: DataFrame, group: str, order: list[str], label: str) -> DataFrame:
    """``rows`` with ``at``, the place of each in its group, from 0: a sort by range, then the counts of each part."""
    ordered = rows.repartitionByRange(F.col(group), *order).sortWithinPartitions(group, *order)
    table = materialize(ordered.withColumns({"part": F.spark_partition_id(), "place": F.monotonically_increasing_id()}), label)
    counts = table.groupBy("part", group).agg(F.count("*").alias("n"), F.min("place").alias("first"))
    earlier = F.expr(f"coalesce(sum(n) OVER (PARTITION BY {group} ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - first")
    shift = cut(counts.select(F.col("part").alias("own"), F.col(group).alias("of"), earlier.alias("shift")))
    same = (F.col("part") == F.col("own")) & F.col(group).eqNullSafe(F.col("of"))
    return table.join(bounded(shift), same).withColumn("at", F.col("place") + F.col("shift")).drop("own", "of", "part", "place", "shift")


def _hashed(level: str) -> str:
    """The level above, as SQL: every ``FAN`` digests of a hex string are one substring."""
    run = FAN * WIDTH
    return f"array_join(transform(sequence(0, CAST(ceil(length({level}) / {run}) AS INT) - 1), i -> sha2(substring({level}, i * {run} + 1, {run}), 256)), '')"


def blocks_of(nodes: DataFrame, group: str, payload: list[str]) -> DataFrame:
    """One row for each aligned block of the nodes ``group, at, node`` (hex): its levels and its top.

    The levels are binary, as substrings of bytes need no walk through
    characters.  A block alone in its group stops at one node; the others go up
    ``STEPS`` levels.
    """
    place = F.struct((F.col("at") % BLOCK).cast("int").alias("i"), "node", *payload)
    made = nodes.groupBy(group, F.floor(F.col("at") / BLOCK).alias("block")).agg(F.array_sort(F.collect_list(place)).alias("items"))
    made = made.withColumns({
        "steps": F.expr(f"CASE WHEN block > 0 THEN {STEPS} " + " ".join(f"WHEN size(items) <= {FAN**k} THEN {k}" for k in range(STEPS)) + f" ELSE {STEPS} END"),
        "level0": F.expr("CAST(array_join(items.node, '') AS BINARY)"),
    })
    for k in range(1, STEPS + 1):
        made = made.withColumn(f"level{k}", F.expr(f"CASE WHEN steps >= {k} THEN CAST({_hashed(f'level{k - 1}')} AS BINARY) END"))
    top = F.coalesce(*[F.col(f"level{k}") for k in range(STEPS, -1, -1)]).cast("string")
    return made.withColumn("top", top).withColumn("items", F.expr(f"transform(items, x -> struct({', '.join(f'x.{c}' for c in ['i', *payload])}))")).drop(f"level{STEPS}")


def _path(i: str) -> str:
    """Siblings of a block's ``i``-th node, level by level, as SQL: the substrings before and after it in its run."""

    def sides(k: int) -> str:
        own = f"({i} DIV {FAN**k})"
        start = f"({own} DIV {FAN} * {FAN})"
        left = f"substring(level{k}, {start} * {WIDTH} + 1, ({own} - {start}) * {WIDTH})"
        right = f"substring(level{k}, ({own} + 1) * {WIDTH} + 1, ({start} + {FAN - 1} - {own}) * {WIDTH})"
        return f"named_struct('left', {left}, 'right', {right})"

    return f"slice(array({', '.join(map(sides, range(STEPS)))}), 1, steps)"


def _folded(path: str, node: str) -> str:
    return f"aggregate({path}, {node}, (h, s) -> sha2(concat(s.left, CAST(h AS BINARY), s.right), 256))"


def tree(nodes: DataFrame, group: str, payload: list[str], label: str) -> list[DataFrame]:
    """Block tables from the leaves up, until each group is one block."""
    rounds = []
    while True:
        rounds.append(materialize(blocks_of(nodes, group, payload), f"{label}-blocks"))
        if rounds[-1].where("block > 0").isEmpty():
            return rounds
        nodes, payload = rounds[-1].select(group, F.col("block").alias("at"), F.col("top").alias("node")), []


def _below(blocks: DataFrame, above: DataFrame, group: str, by_block: bool) -> DataFrame:
    """Blocks with ``above``, the path from their top to the root."""
    above = above.withColumnRenamed(group, "of")
    same = F.col(group).eqNullSafe(F.col("of"))
    if by_block:
        above = above.withColumnRenamed("at", "own")
        same = same & (F.col("block") == F.col("own"))
    return blocks.join(above, same).drop("of", "own")


def _down(rounds: list[DataFrame], above: DataFrame, group: str) -> DataFrame:
    """The leaves' blocks with the path above them; ``above`` has ``group, above`` and what else all of a group share."""
    for k, blocks in reversed(list(enumerate(rounds))):
        found = _below(blocks, above, group, k < len(rounds) - 1)
        if k:
            shared = [c for c in above.columns if c not in (group, "at", "above")]
            item = F.expr(f"explode(transform(items, x -> named_struct('at', block * {BLOCK} + x.i, 'path', concat({_path('x.i')}, above))))")
            above = found.select(group, *shared, item.alias("item")).select(group, *shared, F.col("item.at").alias("at"), F.col("item.path").alias("above"))
    return found


def manifest(docs: DataFrame, fields: dict[str, Column], id_col: str = "doc_id", group_col: str = "lang", changed: dict[str, Column] | None = None) -> DataFrame:
    """``id, leaf, subroot, root, proof_sha256, folded_root, verified`` of every row.

    ``changed`` gives fields as they are when the proof is checked; without it
    every row folds to the root.
    """
    own, seen = leaf_digest(*fields.values()), leaf_digest(*({**fields, **(changed or {})}).values())
    leaves = docs.select(docs[id_col].cast("long").alias("id"), docs[group_col].alias("grp"), F.unhex(own).alias("leaf"), F.unhex(seen).alias("seen"))
    leaves = leaves.withColumn("seen", F.when(F.col("seen") != F.col("leaf"), F.col("seen")))
    at = numbered(leaves, "grp", ["id", "leaf"], "leaves").withColumn("node", F.lower(F.hex("leaf")))
    rounds = tree(at, "grp", ["id", "seen"], "rows")
    subroots = rounds[-1].select(F.lit(0).alias("whole"), F.col("grp").alias("name"), F.col("top").alias("node"))
    upper = tree(numbered(subroots, "whole", ["name"], "subroots"), "whole", ["name"], "groups")
    start = upper[-1].select("whole", F.col("top").alias("root"), F.expr("slice(array(named_struct('left', CAST('' AS BINARY), 'right', CAST('' AS BINARY))), 1, 0)").alias("above"))
    tops = _down(upper, start, "whole").select("root", "above", *[f"level{k}" for k in range(STEPS)], "steps", F.explode("items").alias("x"))
    node = f"CAST(substring(level0, x.i * {WIDTH} + 1, {WIDTH}) AS STRING)"
    tops = tops.select(F.col("x.name").alias("grp"), F.expr(node).alias("subroot"), "root", F.expr(f"concat({_path('x.i')}, above)").alias("above"))
    rows = _down(rounds, bounded(cut(tops)), "grp")
    proof = "sha2(array_join(transform(path, s -> CAST(concat(s.left, s.right) AS STRING)), ''), 256)"
    made = F.expr(f"explode(transform(items, x -> named_struct('id', x.id, 'leaf', {node}, 'seen', x.seen, 'path', concat({_path('x.i')}, above))))")
    out = rows.select("subroot", "root", made.alias("x")).select("subroot", "root", "x.*")
    out = out.select("id", "leaf", "subroot", "root", F.expr(proof).alias("proof_sha256"), F.expr(_folded("path", "coalesce(lower(hex(seen)), leaf)")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    fields = {c: docs[c] for c in ("doc_id", "source", "lang", "n_chars", "text")}
    hit = F.crc32(docs["doc_id"].cast("string")) % 3 == 0
    changed = {"text": F.when(hit, F.translate(docs["text"], UPPER, LOWER)).otherwise(docs["text"])}
    return manifest(docs, fields, changed=changed).withColumnRenamed("id", "doc_id")


def _sql(levels: int = 12) -> str:
    """The same by joins of the nodes of each level."""

    def digest(text: str) -> str:
        texts = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text]
        return "sha256(" + " || ".join(f"coalesce(strlen({t})::VARCHAR || ':' || {t}, '-')" for t in texts) + ")"

    bits = "list_concat([4294967295], flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])))"
    crc = f"xor(list_reduce({bits}, lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295)"
    steps = [
        f"leaves AS (SELECT doc_id, lang, {digest('text')} AS leaf, CASE WHEN {crc} % 3 = 0 THEN {digest(f"translate(text, '{UPPER}', '{LOWER}')")} END AS other FROM documents)",
        "l0 AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM leaves)",
        "n0 AS (SELECT lang AS g, place AS pos, leaf AS node FROM l0)",
        "w0 AS (SELECT doc_id, lang, lang AS g, leaf, coalesce(other, leaf) AS h, '' AS proof, place AS pos, leaf AS subroot FROM l0)",
    ]

    def up(n: str, w: str, k: int, upper: bool) -> list[str]:
        flank = f"""s{n}{k} AS (SELECT *, count(*) OVER (PARTITION BY g) AS total,
          coalesce(string_agg(node, '') OVER (PARTITION BY g, pos // 8 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lt,
          coalesce(string_agg(node, '') OVER (PARTITION BY g, pos // 8 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rt FROM {n}{k})"""
        nodes = f"{n}{k + 1} AS (SELECT g, pos // 8 AS pos, CASE WHEN min(total) = 1 THEN min(node) ELSE sha256(string_agg(node, '' ORDER BY pos)) END AS node FROM s{n}{k} GROUP BY g, pos // 8)"
        walk = f"""{w}{k + 1} AS (SELECT w.doc_id, w.lang, w.g, w.leaf, CASE WHEN total = 1 THEN h ELSE sha256(lt || h || rt) END AS h,
          proof || lt || rt AS proof, w.pos // 8 AS pos, {'subroot' if upper else 's.node AS subroot'} FROM {w}{k} w JOIN s{n}{k} s ON w.g IS NOT DISTINCT FROM s.g AND w.pos = s.pos)"""
        return [flank, nodes, walk]

    for k in range(levels):
        steps += up("n", "w", k, False)
    steps += [
        f"m0 AS (SELECT 0 AS g, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS pos, node, g AS name FROM n{levels})",
        f"v0 AS (SELECT doc_id, lang, 0 AS g, leaf, h, proof, m.pos AS pos, m.node AS subroot FROM w{levels} w JOIN m0 m ON w.lang IS NOT DISTINCT FROM m.name)",
    ]
    for k in range(levels):
        steps += up("m", "v", k, True)
    return f"WITH {', '.join(steps)} SELECT doc_id, leaf, subroot, (SELECT node FROM m{levels}) AS root, sha256(proof) AS proof_sha256, h AS folded_root, h = (SELECT node FROM m{levels}) AS verified FROM v{levels}"


OP12_SQL = _sql()
