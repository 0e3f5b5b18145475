"""Commands: ``python -m weftgraph.cli --root DIR ...`` over tables kept under one folder.

    refresh characters SNAPSHOT      flatten a new snapshot, log what changed, keep it
    chapters FOLDER                  texts of the books below a folder, by the table of patterns in --dims
    list worlds|books|families|keys  what --world, --book, --family and KEY may be
    show|cleanup COMPONENT...        paths of what has been made; cleanup deletes them
    analyze relatives                kinship graphs by scope, or of a --world, --book or --family
    analyze interactions KEY         co-occurrence graph of a key, all keys below it, or ``all``; --discretize by chapter
    disambiguate KEY                 open questions of a key and the keys below it, as a table to be answered;
                                     with --answers FILE, take (key, chapter, pos, char_id) in first
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.wikitext import Dims
from .operators import delta, entities, graph, kin, lexicon, mentions, runs
from .operators.components import written
from .schemas import MIN_WEIGHT
from .session import session
from .sources import graphs, pages

PARTS = {"caches": "pages.parquet", "gml": "graphs/gml", "json": "graphs/json", "logs": "logs", "characters": "entities.parquet", "disambiguation": "resolution", "deltas": "logs/deltas"}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="weftgraph")
    top.add_argument("--root", required=True)
    top.add_argument("--dims", help="JSON file of value tables")
    top.add_argument("--universe", default="")
    sub = top.add_subparsers(dest="command", required=True)
    p = sub.add_parser("refresh")
    p.add_argument("what", choices=["list", "characters"])
    p.add_argument("snapshot", nargs="?")
    sub.add_parser("chapters").add_argument("folder")
    sub.add_parser("list").add_argument("what", choices=["worlds", "books", "families", "keys"])
    sub.add_parser("show").add_argument("what", choices=sorted(PARTS))
    sub.add_parser("cleanup").add_argument("what", nargs="+", choices=["all", *sorted(PARTS)])
    p = sub.add_parser("disambiguate")
    p.add_argument("key")
    p.add_argument("--answers")
    a = sub.add_parser("analyze").add_subparsers(dest="kind", required=True)
    p = a.add_parser("relatives")
    p.add_argument("--format", choices=["gml", "json", "all"], default="all")
    for x in ("--world", "--book", "--family"):
        p.add_argument(x)
    p = a.add_parser("interactions")
    p.add_argument("key")
    p.add_argument("--format", choices=["gml", "json", "all"], default="all")
    p.add_argument("--discretize", action="store_true")
    p.add_argument("--min-weight", type=int, default=MIN_WEIGHT)
    return top


def write(nodes, edges, where: str, form: str, root: str) -> list[str]:
    name, done = where.lower().replace(" ", "_"), []
    if form in ("gml", "all"):
        graphs.write_gml(nodes, edges, done.append(f"{root}/graphs/gml/{name}") or done[-1])
    if form in ("json", "all"):
        graphs.write_nodelink(nodes, edges, done.append(f"{root}/graphs/json/{name}") or done[-1])
    return done


def dims_of(args) -> Dims:
    return Dims(**json.load(open(args.dims, encoding="utf-8"))) if args.dims else Dims()


def people(spark: SparkSession, args):
    dims = dims_of(args)
    return entities.entities(pages.load(spark, f"{args.root}/pages.parquet"), dims, args.universe), dims


def refresh(spark: SparkSession, args) -> list[str]:
    if args.what == "list":
        return ["characters"]
    new, at = pages.flat(pages.snapshot(spark, args.snapshot)), f"{args.root}/pages.parquet"
    done = []
    if pages.exists(spark, at):
        lines = delta.log_lines(delta.with_diff(delta.changes(pages.load(spark, at), new)))
        number = spark.sql("select unix_micros(current_timestamp())").first()[0]
        lines.repartitionByRange("pageid", "at").sortWithinPartitions("pageid", "at").select("line").write.text(done.append(f"{args.root}/logs/deltas/{number}") or done[-1])
    pages.save(new, at)
    return [*done, at]


def answered(found, resolution, who, dims: Dims):
    """``resolution`` without ids that no entity has, and with the default answers."""
    usual = found.sparkSession.createDataFrame(list(dims.defaults.items()), "moniker string, char_id bigint")
    return mentions.recalled(mentions.with_defaults(resolution, found, usual), who)


def chapters(spark: SparkSession, args) -> list[str]:
    out = f"{args.root}/chapters.parquet"
    pages.chapters(spark, args.folder, dims_of(args).chapters).write.mode("overwrite").parquet(out)
    return [out]


def interactions(spark: SparkSession, args, chapters, resolution=None) -> list[str]:
    """``chapters`` (key, chapter, text) of the key and what is below it; without open questions only."""
    who, dims = people(spark, args)
    found = mentions.mentions(mentions.ngrams(chapters), mentions.candidates(lexicon.build(who), who), list(dims.titles))
    found = written(found)
    resolution = graphs.stored_resolution(spark, f"{args.root}/resolution") if resolution is None else resolution
    pairs = written(runs.pairs(runs.runs(mentions.resolved(found, answered(found, resolution, who, dims)))))
    nodes = entities.properties(who)
    if args.discretize:
        out = []
        for key, chapter in sorted(map(tuple, pairs.select("key", "chapter").distinct().collect())):
            e = pairs.where((F.col("key") == key) & (F.col("chapter") == chapter)).select("src", "dst", "weight")
            out += write(graph.connected(nodes, e), e, f"interactions/{key}/{chapter}", args.format, args.root)
        return out
    books = graph.heavy(graph.weighted(pairs, "key"), args.min_weight)
    e = graph.weighted(books)
    return write(graph.connected(nodes, e), e, f"interactions/{args.key}", args.format, args.root)


def relatives(spark: SparkSession, args) -> list[str]:
    who, _ = people(spark, args)
    nodes, edges = kin.graph(who)
    if args.world or args.book or args.family:
        nodes, edges = kin.within(nodes, edges, args.world, args.book, args.family)
        name = args.world or args.book or args.family
        return write(entities.properties(graph.connected(nodes, edges)), edges, f"family/{name}", args.format, args.root)
    out, member = [], graph.scopes(nodes, edges)
    for scope in sorted(r[0] for r in member.select("scope").distinct().collect()):
        own = nodes.join(member.where(F.col("scope") == scope), "id", "left_semi")
        out += write(entities.properties(own), graph.induced(own, edges), f"family/{scope}", args.format, args.root)
    return out


def below(chapters, key: str):
    """Chapters of a key and of the keys that it is a prefix of."""
    return chapters if key == "all" else chapters.where(F.col("key").startswith(key))


def disambiguate(spark: SparkSession, args) -> list[str]:
    who, dims = people(spark, args)
    chapters = below(pages.load(spark, f"{args.root}/chapters.parquet"), args.key)
    at = f"{args.root}/resolution"
    if args.answers:
        new = pages.load(spark, args.answers).selectExpr("cast(key as string) key", "cast(chapter as string) chapter", "cast(pos as int) pos", "cast(char_id as bigint) char_id")
        same = graphs.stored_resolution(spark, at).join(new.select("key", "chapter").distinct(), ["key", "chapter"], "left_semi")
        graphs.write_resolution(written(mentions.merged(same, new)), at)
    known = graphs.stored_resolution(spark, at)
    found = mentions.mentions(mentions.ngrams(chapters), mentions.candidates(lexicon.build(who), who), list(dims.titles))
    out = f"{args.root}/pending.parquet"
    found = written(found)
    mentions.pending(found, answered(found, known, who, dims), chapters).write.mode("overwrite").parquet(out)
    return [out]


def listed(spark: SparkSession, args) -> list[str]:
    """Values to choose from: of the entities' fields, or the chapters' keys and what these start with."""
    if args.what == "keys":
        parts = F.split("key", "/")
        keys = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
        found = pages.load(spark, f"{args.root}/chapters.parquet").select(F.explode(keys).alias("v"))
    else:
        who, _ = people(spark, args)
        found = who.select({"worlds": F.col("world"), "families": F.col("family"), "books": F.explode("books")}[args.what].alias("v"))
    return [r[0] for r in found.where("v is not null").distinct().orderBy("v").collect()]


def cleanup(spark: SparkSession, args) -> list[str]:
    done = []
    for part in sorted(PARTS) if "all" in args.what else args.what:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{args.root}/{PARTS[part]}")
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True):
            done.append(str(path))
    return done


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> list[str]:
    args = parser().parse_args(argv)
    if args.command == "show":
        out = [f"{args.root}/{PARTS[args.what]}"]
    else:
        spark = spark or session()
        if args.command == "analyze" and args.kind == "interactions":
            out = interactions(spark, args, below(pages.load(spark, f"{args.root}/chapters.parquet"), args.key))
        else:
            todo = {"refresh": refresh, "chapters": chapters, "list": listed, "cleanup": cleanup, "disambiguate": disambiguate, "analyze": relatives}
            out = todo[args.command](spark, args)
    print("\n".join(out))
    return out


if __name__ == "__main__":
    main()
