"""Sharding by a hierarchical weighted hash tree.

From the root a document goes to a region, there to a rack and there to a shard. At each level every child draws
-ln(u) / weight, u being hashed from the child's path (the names from the region down, so that nodes of one name under
different parents draw apart) and the document's id, and the least draw wins. Weights are the
children's own, not sums of what lies below, so a change of weight moves documents only among the children of that
node's parent, and a child whose weight grows only gains.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = ("region", "rack", "shard")
#: Regions of unequal size; every second rack has larger machines. Names of racks and shards repeat.
TREE = {
    region: (weight, {f"r{r}": (1.0 + r % 2, {f"s{s}": (1.0, {}) for s in range(8)}) for r in range(racks)})
    for region, weight, racks in (("east", 5.0, 5), ("west", 3.0, 3), ("north", 2.0, 2))
}
_STEPS = 1 << 52
#: Between the names of a path and the id.
_JOIN = "\x1f"


def _children(tree: dict, depth: int) -> Column:
    out = []
    for name, (weight, below) in sorted(tree.items()):
        if weight <= 0:
            continue
        fields = [F.lit(name).alias("name"), F.lit(float(weight)).alias("weight")]
        if depth + 1 < len(LEVELS):
            fields.append(_children(below, depth + 1).alias("below"))
        out.append(F.struct(*fields))
    if not out:
        raise ValueError(f"no {LEVELS[depth]} of positive weight")
    return F.array(*out)


def _drawn(children: Column, path: list[Column], key: Column) -> Column:
    def draw(c: Column, i: Column) -> Column:
        u = (F.conv(F.substring(F.md5(F.concat_ws(_JOIN, *path, c["name"], key)), 1, 13), 16, 10).cast("double") + 0.5) / _STEPS
        return F.struct((-F.log(u) / c["weight"]).alias("draw"), i.alias("i"))

    return F.get(children, F.array_min(F.transform(children, draw))["i"])


def sharded(docs: DataFrame, tree: dict = TREE, id_column: str = "doc_id") -> DataFrame:
    """docs with the columns region, rack and shard, which replace any of these names.

    The place depends on the id and the tree alone: repeated rows and rows of one id go together, a null id is placed
    like the text "null". Nodes of weight 0 or less get nothing; a node of positive weight without such a child is an
    error. Texts are not looked at. An empty table stays empty. No data moves between tasks.
    """
    key = F.coalesce(F.col(id_column).cast("string"), F.lit("null"))
    kept = docs.drop(*[c for c in docs.columns if c.lower() in LEVELS])
    row = kept.select(F.struct("*").alias("row"), key.alias("key"))
    row = row.withColumn("region", _drawn(_children(tree, 0), [], F.col("key")))
    row = row.withColumn("rack", _drawn(F.col("region.below"), [F.col("region.name")], F.col("key")))
    row = row.withColumn("shard", _drawn(F.col("rack.below"), [F.col("region.name"), F.col("rack.name")], F.col("key")))
    return row.select("row.*", *(F.col(f"{x}.name").alias(x) for x in LEVELS))


def nodes(tree: dict = TREE) -> list[tuple[int, str, str, float]]:
    """(level, path of the parent, name, weight) of all nodes; the root's path is empty."""
    out, level, todo = [], 0, [((), tree)]
    while todo:
        nxt = []
        for path, children in todo:
            for name, (weight, below) in children.items():
                out.append((level, _JOIN.join(path), name, weight))
                nxt.append(((*path, name), below))
        level, todo = level + 1, [x for x in nxt if x[1]]
    return out


def oracle(tree: dict = TREE) -> str:
    values = ", ".join(f"({lv}, '{p}', '{n}', {w}::double)" for lv, p, n, w in nodes(tree) if w > 0)
    id_ = "coalesce(d.doc_id::varchar, 'null')"

    def step(source: str, above: list[str]) -> str:
        path = ", ".join(f"d.{x}" for x in above)
        hashed = f"concat_ws(chr(31), {path + ', ' if above else ''}n.name, {id_})"
        score = f"-ln((('0x' || substr(md5({hashed}), 1, 13))::bigint + 0.5) / {_STEPS}::double) / n.weight"
        parent = f"concat_ws(chr(31), {path})" if above else "''"
        cols = ", ".join(f"d.{x}" for x in ("doc_id", *above))
        return f"select {cols}, arg_min(n.name, {score}) as {LEVELS[len(above)]} from {source} d join n on n.level = {len(above)} and n.parent = {parent} group by all"

    return f"""
with n(level, parent, name, weight) as (values {values}),
a as ({step("documents", [])}),
b as ({step("a", ["region"])})
{step("b", ["region", "rack"])}
"""
