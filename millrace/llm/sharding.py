"""Placement of documents on shards by a weighted hash tree.

At each level a document draws -ln(u) / weight for every child of the node it has
reached, u being a hash of document and child, and goes to the smallest draw. A
child's draw depends on that child alone: when a weight changes, only documents
that move to or from that child move, and none outside its parent's subtree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: node -> {child: weight}; "" is the root. A node's name is its whole path.
Tree = dict[str, dict[str, float]]
LEVELS = ("region", "rack", "shard")
_DIGITS = 13


def uniform_tree(regions: dict[str, float], racks: int, shards: int) -> Tree:
    """A tree of so many racks in each region and shards in each rack; the last rack counts double, and shards grow by a quarter."""
    tree: Tree = {"": dict(regions)}
    for region in regions:
        tree[region] = {f"{region}/rack{k}": 2.0 if k == racks - 1 else 1.0 for k in range(racks)}
        for rack in tree[region]:
            tree[rack] = {f"{rack}/shard{k}": 1.0 + 0.25 * k for k in range(shards)}
    return tree


PRODUCTION = uniform_tree({"east": 3.0, "north": 2.0, "west": 1.0}, racks=3, shards=4)


def document_key(docs: DataFrame) -> Column:
    """What is hashed: doc_id; the text's MD5 where doc_id is null; a constant where both are."""
    text = F.md5(F.col("text")) if "text" in docs.columns else F.lit(None).cast("string")
    return F.coalesce(F.col("doc_id").cast("string"), text, F.lit("none"))


def _descend(key: Column, node: Column, tree: Tree) -> Column:
    live = {p: {c: w for c, w in kids.items() if w and w > 0} for p, kids in tree.items()}
    pairs = [(p, sorted(kids.items())) for p, kids in live.items() if kids]
    children = F.create_map(*[x for p, kids in pairs for x in (F.lit(p), F.array(*[F.struct(F.lit(c).alias("child"), F.lit(float(w)).alias("weight")) for c, w in kids]))])
    draws = F.transform(
        F.try_element_at(children, node),
        lambda c: F.struct(
            (-F.ln((F.conv(F.substring(F.md5(F.concat(key, F.lit("|"), c["child"])), 1, _DIGITS), 16, 10).cast("double") + 0.5) / F.lit(float(16**_DIGITS))) / c["weight"]).alias("draw"),
            c["child"].alias("child"),
        ),
    )
    return F.array_min(draws)["child"]


def assign(docs: DataFrame, tree: Tree = PRODUCTION, levels: tuple[str, ...] = LEVELS) -> DataFrame:
    """doc_id and, for each level, the node on the way to its shard. One row for each row of docs; no shuffle.

    Equal doc_ids, repeated rows among them, go together. A null doc_id is placed by
    its text, and where that is null too, all such rows go to one place. A child whose
    weight is null, zero or negative is never drawn; below a node without
    drawable children the levels are null. Equal draws go to the smaller name. Other columns are ignored.
    """
    out = docs.select("doc_id", document_key(docs).alias("key"))
    parts = [{p: k for p, k in tree.items() if (p == "" and not i) or (p and p.count("/") == i - 1)} for i in range(len(levels))]
    node: Column = F.lit("")
    for level, part in zip(levels, parts):
        has = any(w and w > 0 for kids in part.values() for w in kids.values())
        out = out.withColumn(f"at_{level}", _descend(F.col("key"), node, part) if has else F.lit(None).cast("string"))
        node = F.col(f"at_{level}")
    return out.select("doc_id", *[F.col(f"at_{level}").alias(level) for level in levels])


def moved(docs: DataFrame, before: Tree, after: Tree) -> DataFrame:
    """doc_id, shard_before, shard_after of the rows whose shard differs between two trees."""
    leaf = LEVELS[-1]
    both = docs.select("doc_id", *([F.col("text")] if "text" in docs.columns else []))
    a = assign(both, before).withColumnRenamed(leaf, "shard_before").select("doc_id", "shard_before").distinct()
    b = assign(both, after).withColumnRenamed(leaf, "shard_after").select("doc_id", "shard_after").distinct()
    return a.where("doc_id IS NOT NULL").join(b, "doc_id").where(~F.col("shard_before").eqNullSafe(F.col("shard_after")))


def assign_sql(tree: Tree = PRODUCTION, levels: tuple[str, ...] = LEVELS, table: str = "documents") -> str:
    """DuckDB SQL for assign()."""
    rows = ", ".join(f"('{p}', '{c}', {float(w)!r}::DOUBLE)" for p, kids in tree.items() for c, w in kids.items() if w and w > 0)
    sql = [f"WITH tree(parent, child, weight) AS (VALUES {rows}), l0 AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(doc_id::VARCHAR, md5(text), 'none') AS k, '' AS at0 FROM {table})"]
    for i, level in enumerate(levels):
        draw = f"-ln((('0x' || substr(md5(l.k || '|' || t.child), 1, {_DIGITS}))::BIGINT::DOUBLE + 0.5) / {float(16**_DIGITS)!r}) / t.weight"
        seen = "".join(f", any_value(l.at{j}) AS at{j}" for j in range(i + 1))
        sql.append(f"l{i + 1} AS (SELECT l.rid, any_value(l.doc_id) AS doc_id, any_value(l.k) AS k{seen}, arg_min(t.child, ({draw}, t.child)) AS at{i + 1} FROM l{i} l LEFT JOIN tree t ON t.parent = l.at{i} GROUP BY l.rid)")
    last = len(levels)
    return ", ".join(sql) + " SELECT doc_id, " + ", ".join(f"at{i + 1} AS {level}" for i, level in enumerate(levels)) + f" FROM l{last}"
