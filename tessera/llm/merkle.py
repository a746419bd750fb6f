"""A Merkle manifest of a dataset: a leaf for every row, a subtree for every group, one root, and a proof for every leaf.

Leaves of a group stand in the order of a key (nulls first, equal keys by digest); every ``ARITY`` consecutive nodes, or what is
left at the end, become their common digest until one remains. The groups' roots, ordered bytewise with null first, become the root likewise.

Ranks come without a global sort in one task: rows are range-partitioned by (group, key, digest), numbered within their task, and
a small table holds where each task's part of a group begins. So a group of any size is spread over tasks.

The tree is built by rolling up digits of the ranks. Nodes are dealt once by blocks of ``ARITY ** DEPTH`` consecutive ranks of a group;
within a block the digits are grouped away one after another, each time nesting the structs of the children below their digest, so a block
is one row of bounded size. The digests of the blocks are the nodes of the next layer, a row for each 243 nodes below. Proofs
are emitted from the nested structs from the top on: exploding a level yields each child with what stands left and right of it, put before the
path of its parent; within blocks no leaf is joined with anything. Only a block meets the path of its own digest, by one join of a row
a block, broadcast where its rows are few by count.

Only DataFrame functions are used. Defined results: nulls are marked in leaves and never equal to texts; a null key comes first; rows that are
equal in all columns are leaves of their own with equal digests; a group of one row has its leaf for root; the proof of the only row of the only group is
empty; an empty table gives an empty result; columns that no leaf names are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import forget, materialise, table

ARITY = 3
DEPTH = 5  # levels within a block
#: Up to so many rows (a path has under 6 kB) a table of paths or of offsets is broadcast.
FEW_ROWS = 4000
#: And up to so many bytes of group names in it.
FEW_BYTES = 8 << 20

_DIGITS = [f"_d{k}" for k in range(DEPTH)]
#: The columns of documents in the order in which they enter a leaf.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """A value with its length in bytes before it, so that no two lists of values have the same concatenation; null is a mark of its own."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def _group(c: Column) -> Column:
    """A group as a key that is never null and sorts as the group does, null first."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))


def _small(df: DataFrame) -> DataFrame:
    """``df``, whose names are in ``_g``, for a join: broadcast if its rows and names are few by count."""
    rows, names = df.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("_g")), F.lit(0))).first()
    return F.broadcast(df) if rows <= FEW_ROWS and names <= FEW_BYTES else df


def ranked(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``at``, the place from 0 on within ``_g``, and ``height``, the levels of the tree above the leaves of ``_g``.

    ``forget`` deletes the table behind the result.
    """
    dealt = rows.repartitionByRange("_g", *order).sortWithinPartitions("_g", *order)
    placed = materialise(dealt.withColumn("_row", F.monotonically_increasing_id()))  # the task's number above 33 bits for the row's
    part = F.shiftright("_row", 33).alias("_part")
    runs = placed.groupBy("_g", part).agg(F.min("_row").alias("_first"), F.count("*").alias("_rows"))
    before = Window.partitionBy("_g").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task of a group
    nodes = F.sum("_rows").over(Window.partitionBy("_g"))
    powers = F.array(*(F.lit(ARITY**k) for k in range(39)))
    runs = runs.select(
        "_g", "_part", (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift"), F.size(F.filter(powers, lambda p: p < nodes)).alias("height")
    )
    out = placed.withColumn("_part", part).join(_small(runs), ["_g", "_part"]).withColumn("at", F.col("_row") + F.col("_shift")).drop("_part", "_row", "_shift")
    out._table_path = placed._table_path
    return out


def rollup(nodes: DataFrame, below: int) -> DataFrame:
    """A row for each block of ``nodes`` (_g, at, height, digest, item): its digest and its nested children. ``below`` levels lie beneath."""
    at = F.col("at")
    t = nodes.select(
        "_g", "height", F.floor(at / ARITY**DEPTH).alias("block"),
        *((F.floor(at / ARITY**k) % ARITY).cast("int").alias(d) for k, d in enumerate(_DIGITS)), "digest", "item",
    )
    t = t.repartition("_g", "block").withColumn("node", F.struct(F.col("_d0").alias("digit"), "digest", "item"))
    for k in range(DEPTH):
        t = t.groupBy("_g", "block", "height", *_DIGITS[k + 1 :]).agg(F.array_sort(F.collect_list("node")).alias("kids"))
        # above the top of a small group its root is passed on as it is
        together = F.when(F.col("height") > below + k, F.sha2(F.array_join("kids.digest", ""), 256)).otherwise(F.col("kids")[0]["digest"])
        t = t.withColumn("digest", together)
        if k + 1 < DEPTH:
            t = t.withColumn("node", F.struct(F.col(_DIGITS[k + 1]).alias("digit"), "digest", "kids"))
    return t.select("_g", "block", "height", "digest", "kids")


def layers(nodes: DataFrame) -> list[DataFrame]:
    """The blocks of ``nodes``, the blocks of those blocks, and so on up to a single block for each group."""
    out = [materialise(rollup(nodes, 0))]
    while not out[-1].where("block > 0").isEmpty():
        above = out[-1].select("_g", F.col("block").alias("at"), "height", "digest", F.lit(None).cast("int").alias("item"))
        out.append(materialise(rollup(above, DEPTH * len(out))))
    return out


def _explode(blocks: DataFrame, below: int, kept: list[str]) -> DataFrame:
    """The nodes of ``blocks`` (with ``path``, that of the block): _g, at, digest, item, path, kept."""
    t = blocks.withColumn("at", F.col("block"))
    for k in reversed(range(DEPTH)):
        t = t.withColumn("run", F.col("kids.digest")).select("_g", "height", "at", "path", "run", *kept, F.explode("kids").alias("kid"))
        digit = F.col("kid.digit")
        step = F.struct(F.array_join(F.slice("run", F.lit(1), digit), "").alias("left"), F.array_join(F.slice("run", digit + 2, F.lit(ARITY)), "").alias("right"))
        t = t.select(
            "_g", "height", (F.col("at") * ARITY + digit).alias("at"), *kept, F.col("kid.digest").alias("digest"),
            F.when(F.col("height") > below + k, F.concat(F.array(step), "path")).otherwise(F.col("path")).alias("path"),
            *([F.col("kid.kids").alias("kids")] if k else [F.col("kid.item").alias("item")]),
        )
    return t


def proofs(made: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The nodes of the lowest layer with their paths; ``tops`` has a row for each group: _g, path, and columns that its nodes get."""
    kept = [c for c in tops.columns if c not in ("_g", "path")]
    paths = tops.withColumn("block", F.lit(0).cast("long"))
    for number in reversed(range(len(made))):
        t = _explode(made[number].join(_small(paths), ["_g", "block"]), DEPTH * number, kept)
        if number:
            paths = t.select("_g", F.col("at").alias("block"), "path", *kept)
    return t


_PATH = "array<struct<left:string,right:string>>"


def merkle_manifest(rows: DataFrame, group: Column, key: Column, digest: Column, **carried: Column) -> DataFrame:
    """The columns ``carried`` of every row with leaf, subroot, root and path, an array of (left, right): what stands beside the node level by level."""
    item = F.struct(*(c.alias(name) for name, c in carried.items())) if carried else F.struct(F.lit(0).alias("_"))
    leaves = ranked(rows.select(_group(group).alias("_g"), key.alias("_key"), digest.alias("digest"), item.alias("item")), "_key", "digest")
    below = layers(leaves)
    forget(leaves)
    # the groups' roots are the nodes of one more tree
    roots = below[-1].select(F.col("_g").alias("name"), "digest").select(F.lit("").alias("_g"), "name", "digest", F.struct("name", F.col("digest").alias("subroot")).alias("item"))
    subroots = ranked(roots, "name")
    above = layers(subroots.drop("name"))
    forget(subroots)
    top = above[-1].select("_g", F.array().cast(_PATH).alias("path"), F.col("digest").alias("root"))
    groups = proofs(above, top).select(F.col("item.name").alias("_g"), "path", F.col("item.subroot").alias("subroot"), "root")
    groups = materialise(groups)  # read once a layer and by the counts that decide about broadcasts
    forget(*above)
    out = proofs(below, groups)
    return out.select(*(F.col(f"item.`{name}`").alias(name) for name in carried), F.col("digest").alias("leaf"), "subroot", "root", "path")


def proof_digest(path: Column) -> Column:
    """The digest of all nodes beside the path, level by level."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def folded(digest: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, digest, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of ``documents``; where 2 divides the checksum of an id, line feeds are deleted from the text, and the root folded from it is compared."""
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    values = [F.col(c) for c in FIELDS]
    tampered = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 2 == 0
    changed = F.when(tampered, leaf(*values[:-1], F.replace("text", F.lit("\n"), F.lit(""))))
    made = merkle_manifest(docs, F.col("source"), F.col("doc_id"), leaf(*values), doc_id=F.col("doc_id"), changed=changed)
    made = made.withColumn("folded_root", folded(F.coalesce("changed", "leaf"), F.col("path")))
    return made.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


#: ``paths`` has a row for each node and level; levels of the tree over sources count from 1000 on. The checksum's lowest bit is found bit by bit.
OP11_SQL = r"""
WITH RECURSIVE fields AS (
  SELECT *, coalesce('=' || source, '') AS g, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
    replace(text, chr(10), '') AS flat,
    list_reduce(range(8 * strlen(doc_id::VARCHAR)), lambda c, i: xor(
        xor(c, CASE WHEN i % 8 = 0 THEN ascii(substr(doc_id::VARCHAR, (i // 8 + 1)::BIGINT, 1))::BIGINT ELSE 0 END) >> 1,
        xor(c, CASE WHEN i % 8 = 0 THEN ascii(substr(doc_id::VARCHAR, (i // 8 + 1)::BIGINT, 1))::BIGINT ELSE 0 END) % 2 * 3988292384), 4294967295::BIGINT) AS crc
  FROM documents
),
leaves AS (
  SELECT doc_id, g, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS h,
         CASE WHEN xor(crc, 4294967295) % 2 = 0 THEN sha256(head || coalesce(strlen(flat) || ':' || flat, '-')) END AS changed
  FROM fields
),
placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS pos FROM leaves),
nodes AS (
  SELECT 0 AS level, g, pos, h FROM placed
  UNION ALL
  SELECT any_value(level) + 1, g, pos // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM nodes) WHERE n > 1 GROUP BY g, pos // 3
),
subroots AS (SELECT g, arg_max(h, level) AS h, max(level) AS height, row_number() OVER (ORDER BY g) - 1 AS pos FROM nodes GROUP BY g),
tops AS (
  SELECT 1000 AS level, pos, h FROM subroots
  UNION ALL
  SELECT any_value(level) + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER () AS n FROM tops) WHERE n > 1 GROUP BY pos // 3
),
root AS (SELECT arg_max(h, level) AS root, max(level) AS height FROM tops),
runs AS (
  SELECT level, g, pos // 3 AS run, list(h ORDER BY pos) AS hs FROM nodes GROUP BY level, g, pos // 3
  UNION ALL SELECT level, NULL, pos // 3, list(h ORDER BY pos) FROM tops GROUP BY level, pos // 3
),
steps AS (
  SELECT p.doc_id, p.g, p.pos, r.level, array_to_string(r.hs[:(p.pos // pow(3, r.level)::BIGINT) % 3], '') AS l, array_to_string(r.hs[(p.pos // pow(3, r.level)::BIGINT) % 3 + 2:], '') AS rest
  FROM placed p JOIN subroots s ON p.g = s.g JOIN runs r ON r.g = p.g AND r.level < s.height AND r.run = p.pos // pow(3, r.level + 1)::BIGINT
  UNION ALL
  SELECT p.doc_id, p.g, p.pos, r.level, array_to_string(r.hs[:(s.pos // pow(3, r.level - 1000)::BIGINT) % 3], ''), array_to_string(r.hs[(s.pos // pow(3, r.level - 1000)::BIGINT) % 3 + 2:], '')
  FROM placed p JOIN subroots s ON p.g = s.g JOIN root ON true JOIN runs r ON r.g IS NULL AND r.level < root.height AND r.run = s.pos // pow(3, r.level - 999)::BIGINT
),
paths AS (SELECT g, pos, list({'l': l, 'r': rest} ORDER BY level) AS path FROM steps GROUP BY g, pos),
folds AS (
  SELECT p.g, p.pos, 0 AS done, coalesce(changed, h) AS h, coalesce(path, []) AS path FROM placed p LEFT JOIN paths USING (g, pos)
  UNION ALL
  SELECT g, pos, done + 1, sha256(path[done + 1].l || h || path[done + 1].r), path FROM folds WHERE done < len(path)
)
SELECT p.doc_id, p.h AS leaf, s.h AS subroot, root, sha256(array_to_string(list_transform(f.path, lambda x: x.l || x.r), '')) AS proof_sha256, f.h AS folded_root, f.h = root AS verified
FROM placed p JOIN subroots s ON p.g = s.g JOIN folds f ON f.g = p.g AND f.pos = p.pos AND f.done = len(f.path) JOIN root ON true
"""
