"""Graph files: GML and node-link JSON, and tables of resolutions as YAML."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ordinals(nodes: DataFrame) -> DataFrame:
    """Nodes with ``ordinal``, their rank by id from 0: counts below range partitions' bounds, then ranks within them."""
    ranged = nodes.select("id").repartitionByRange("id").withColumn("p", F.spark_partition_id())
    from ..operators.components import written

    ranged = written(ranged)
    per = ranged.groupBy("p").agg(F.count(F.lit(1)).alias("n")).select("p", (F.coalesce(F.sum("n").over(W.orderBy("p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).alias("o"))
    ranked = ranged.join(F.broadcast(per), "p")  # a row for each partition
    return ranked.select("id", (F.row_number().over(W.partitionBy("p").orderBy("id")) - 1 + F.col("o")).cast("bigint").alias("ordinal"))


def _value(column: str, kind: T.DataType):
    c, quote = F.col(column), lambda x: F.concat(F.lit('"'), F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&#34;")), F.lit('"'))
    line = lambda x, pad: F.concat(F.lit(f"{pad}{column} "), x)
    none = F.array(F.lit(f'    {column} "null"'))
    if isinstance(kind, T.ArrayType):
        return F.when(F.coalesce(F.size(c), F.lit(0)) <= 0, none).otherwise(F.transform(c, lambda x: line(quote(x.cast("string")), "      ")))
    if isinstance(kind, T.BooleanType):
        return F.when(c.isNull(), none).otherwise(F.array(line(F.when(c, "1").otherwise("0"), "    ")))
    if isinstance(kind, T.StringType):
        return F.when(F.coalesce(c, F.lit("")) == "", none).otherwise(F.array(line(quote(c), "    ")))
    return F.when(c.isNull(), none).otherwise(F.array(line(c.cast("string"), "    ")))


def gml_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, a, b, at, line): the lines of a GML file; sort by the first four.

    Node ids are ordinals and labels the entity ids.  Missing, empty and blank values are all "null", so they can't be
    told apart when read; a list is a repeated, deeper indented key.
    """
    ranks = ordinals(nodes)
    body = F.concat(*[_value(f.name, f.dataType) for f in nodes.schema if f.name != "id"], F.array().cast("array<string>"))
    head = F.array(F.lit("  node ["), F.concat(F.lit("    id "), F.col("ordinal").cast("string")), F.concat(F.lit('    label "'), F.col("id").cast("string"), F.lit('"')))
    n = nodes.join(ranks, "id").select(F.lit(1).alias("part"), F.col("ordinal").alias("a"), F.lit(0).cast("bigint").alias("b"), F.posexplode(F.concat(head, body, F.array(F.lit("  ]")))).alias("at", "line"))
    e = edges.join(ranks.toDF("src", "a"), "src").join(ranks.toDF("dst", "b"), "dst")
    extra = [F.array(F.concat(F.lit("    weight "), F.col("weight").cast("string")))] if "weight" in edges.columns else []
    lines = F.concat(F.array(F.lit("  edge ["), F.concat(F.lit("    source "), F.col("a").cast("string")), F.concat(F.lit("    target "), F.col("b").cast("string"))), *extra, F.array(F.lit("  ]")))
    e = e.select(F.lit(2).alias("part"), "a", "b", F.posexplode(lines).alias("at", "line"))
    ends = nodes.sparkSession.createDataFrame([(0, 0, 0, 0, "graph ["), (3, 0, 0, 0, "]")], "part int, a bigint, b bigint, at int, line string")
    return ends.unionByName(n).unionByName(e)


def write_gml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A folder of text parts whose names sort in the order of the lines."""
    gml_lines(nodes, edges).repartitionByRange("part", "a", "b", "at").sortWithinPartitions("part", "a", "b", "at").select("line").write.mode("overwrite").text(path)


def read_gml(text: str) -> tuple[list[dict], list[dict]]:
    """Nodes and edges of one GML file, as dictionaries; deeper indented keys are lists, and edges' ends become entity ids."""
    nodes: list[dict] = []
    edges: list[dict] = []
    item: dict | None = None
    for raw in text.splitlines():
        line, pad = raw.strip(), len(raw) - len(raw.lstrip())
        if line in ("node [", "edge ["):
            item = {}
            (nodes if line[0] == "n" else edges).append(item)
        elif line == "]" or line == "graph [":
            item = None
        elif item is not None:
            key, _, value = line.partition(" ")
            got = value[1:-1].replace("&#34;", '"').replace("&amp;", "&") if value[:1] == '"' else int(value)
            if got == "null":
                got = None
            if pad >= 6:
                item.setdefault(key, []).append(got)
            else:
                item[key] = got
    labels = {n["id"]: int(n["label"]) for n in nodes}
    for n in nodes:
        if "alive" in n:
            n.setdefault("living", n.pop("alive"))
        n["id"] = int(n.pop("label"))
    for e in edges:
        e["source"], e["target"] = labels[e["source"]], labels[e["target"]]
    return nodes, edges


def nodelink(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, a, b, item): node-link JSON objects; nulls, booleans and empty lists stay what they are."""
    keep = {"ignoreNullFields": "false"}
    attributes = [c for c in nodes.columns if c != "id"]
    n = nodes.select(F.lit("node").alias("kind"), F.col("id").alias("a"), F.lit(None).cast("bigint").alias("b"), F.to_json(F.struct(*attributes, "id"), keep).alias("item"))
    w = ["weight"] if "weight" in edges.columns else []
    e = edges.select(F.lit("link").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), F.to_json(F.struct(*w, F.col("src").alias("source"), F.col("dst").alias("target")), keep).alias("item"))
    return n.unionByName(e)


def write_nodelink(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """One JSON document.  A browser reads it whole, so it is a single line; its items are put in order by a sort, not by the driver."""
    rows = nodelink(nodes, edges).groupBy("kind").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("a", "b", "item"))), lambda x: x["item"]), ", ").alias("items"))
    part = lambda k: F.coalesce(F.max(F.when(F.col("kind") == k, F.col("items"))), F.lit(""))
    text = F.concat(F.lit('{"directed": false, "multigraph": false, "graph": {}, "nodes": ['), part("node"), F.lit('], "links": ['), part("link"), F.lit("]}"))
    rows.agg(text.alias("value")).write.mode("overwrite").text(path)


def read_nodelink(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    doc = spark.read.option("multiLine", True).json(path)
    nodes = doc.select(F.explode("nodes").alias("n")).select("n.*")
    if "alive" in nodes.columns:
        nodes = nodes.withColumnRenamed("alive", "living") if "living" not in nodes.columns else nodes.withColumn("living", F.coalesce("living", "alive")).drop("alive")
    edges = doc.select(F.explode("links").alias("e")).select(F.col("e.source").alias("src"), F.col("e.target").alias("dst"), "e.*").drop("source", "target")
    return nodes, edges


class NoResolution(FileNotFoundError):
    pass


class BadResolution(ValueError):
    pass


def read_resolution(spark: SparkSession, path: str, key: str, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """(key, chapter) and (key, chapter, pos, char_id) of a YAML file of chapter -> position -> id or null.

    Strict: a missing file is an error; else it is as if it were empty.  Whatever is no mapping is an error in either case.
    """
    import yaml

    from .pages import exists

    data: object = {}
    if exists(spark, path):
        data = yaml.safe_load("\n".join(r[0] for r in spark.read.text(path, wholetext=True).toLocalIterator()))
        data = {} if data is None and not strict else data
    elif strict:
        raise NoResolution(path)
    if not isinstance(data, dict) or not all(v is None or isinstance(v, dict) for v in data.values()):
        raise BadResolution(path)
    chapters = spark.createDataFrame([(key, str(c)) for c in data], "key string, chapter string")
    rows = [(key, str(c), int(p), i) for c, v in data.items() for p, i in (v or {}).items()]
    return chapters, spark.createDataFrame(rows, "key string, chapter string, pos int, char_id bigint")


def stored_resolution(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_resolution`` has written; empty where there is nothing.  Keys and chapters stay strings."""
    from .pages import exists

    schema = "key string, chapter string, pos int, char_id bigint"
    return spark.read.schema(schema).parquet(path).select("key", "chapter", "pos", "char_id") if exists(spark, path) else spark.createDataFrame([], schema)


def write_resolution(rows: DataFrame, path: str) -> None:
    """By (key, chapter), so that a chapter is replaced without touching the others."""
    rows.repartition("key", "chapter").sortWithinPartitions("key", "chapter", "pos").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("key", "chapter").parquet(path)
