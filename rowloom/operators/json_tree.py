"""JSON of any depth: its nodes as rows, records flattened with what they lie under, and records of retired ids cut out."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .steps import kept

PRUNED = "struct<json:string,removed:int>"


def nodes(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, path (names and places from the root), depth, kind (OBJECT, ARRAY or the scalar's type) and value (its JSON) of every node.

    A round opens one more level of all texts at once; there are as many rounds as the deepest text has levels. Null texts and texts
    that are no JSON give no nodes, repeated keys the nodes of each. A JSON null is a node of kind VOID.
    """
    level = rows.select(F.col(key), F.try_parse_json(text).alias("v")).where("v is not null").withColumn("path", F.array().cast("array<string>"))
    level, out = kept(level), None
    kind = F.regexp_extract(F.schema_of_variant("v"), "^[A-Z]+", 0)
    while True:
        found = level.select(key, "path", F.size("path").alias("depth"), kind.alias("kind"), F.to_json("v").alias("value"))
        out = found if out is None else out.unionByName(found)
        spark = level.sparkSession
        containers = level.where(kind.isin("OBJECT", "ARRAY"))
        if not containers.limit(1).count():
            return out
        name = f"json_level_{id(level)}"
        containers.createOrReplaceTempView(name)
        below = spark.sql(f"SELECT c.`{key}`, concat(c.path, array(coalesce(n.key, cast(n.pos as string)))) AS path, n.value AS v FROM {name} c, LATERAL variant_explode(c.v) n")
        level = kept(below)
        spark.catalog.dropTempView(name)


def leaves(rows: DataFrame, key: str, text: str, levels: list[str], fields: list[list[str]]) -> DataFrame:
    """Records of nested arrays, flattened: of each record of the last level its own fields and those of all it lies under.

    levels: names of the arrays from the outside in; fields: of each level the names of its scalars that are wanted. Columns are
    `level_field`. Records without a next array end there and give no row; the arrays are opened one after the other, in place.
    """
    current = rows.select(F.col(key), F.try_parse_json(text).alias("v")).where("v is not null")
    columns = [F.col(key)]
    for level, wanted in zip(levels, fields, strict=True):
        held = F.expr(f"try_variant_get(v, '$.{level}', 'array<variant>')")
        current = current.select(*columns, F.explode(held).alias("v"))
        new = [F.expr(f"try_variant_get(v, '$.{field}', 'string')").alias(f"{level}_{field}") for field in wanted]
        current = current.select(*columns, *new, "v")
        columns += [F.col(f"{level}_{field}") for field in wanted]
    return current.drop("v")


def _prune(value, names: list[str], beside: list[str], retired: set[str]):
    """value without the records of retired ids, and their number; a stack instead of calls, so that depth is no limit here."""
    holds = lambda item, keys: isinstance(item, dict) and any(item.get(k) in retired for k in keys)
    if holds(value, names):
        return None, 1
    removed, stack = 0, [value]
    while stack:
        node = stack.pop()
        if isinstance(node, list):
            kept_items = [item for item in node if not holds(item, [*names, *beside])]
            removed += len(node) - len(kept_items)
            node[:] = kept_items
            stack += kept_items
        elif isinstance(node, dict):
            for name, item in node.items():
                if holds(item, names):
                    node[name], removed = None, removed + 1
                else:
                    stack.append(item)
    return value, removed


def pruned(names: list[str], beside: list[str], retired: list[str]):
    """A function of a JSON column that gives json (without the records whose `names`, or in arrays also `beside`, hold a retired id) and removed.

    Records go from arrays; elsewhere null stands in their place. Null and what is no JSON come back as they are with removed 0.
    """

    @F.pandas_udf(PRUNED)
    def prune(texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            try:
                value, removed = _prune(json.loads(text), names, beside, set(retired)) if text is not None else (None, 0)
                out.append((json.dumps(value, ensure_ascii=False) if removed else text, removed))
            except (ValueError, RecursionError):
                out.append((text, 0))
        return pd.DataFrame(out, columns=["json", "removed"])

    return prune
