"""Scans and sinks of the file formats the engine knows, as tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from signflow.functions.signs import decode
from signflow.functions.storage import numbered
from signflow.functions.text import escape_literal, percent_encode, to_base64url
from signflow.sources.fragments import compose, read_fragments

__all__ = ["compose", "read_fragments"]

def read_obo(spark: SparkSession, path: str, wanted: DataFrame | None = None) -> DataFrame:
    """(id, label, synonyms, parents, obsolete, replaced_by) of an OBO file's terms; ``wanted`` (id) keeps those alone."""
    t = spark.read.option("lineSep", "\n[").text(path).where(F.startswith("value", F.lit("Term]")))

    def tag(name: str) -> Column:
        return F.regexp_extract("value", rf"(?m)^{name}: (.*?)(?: !.*)?$", 1)

    out = t.select(
        tag("id").alias("id"),
        tag("name").alias("label"),
        F.regexp_extract_all("value", F.lit(r'(?m)^synonym: "((?:[^"\\]|\\.)*)"'), F.lit(1)).alias("synonyms"),
        F.regexp_extract_all("value", F.lit(r"(?m)^is_a: (\S+)"), F.lit(1)).alias("parents"),
        (tag("is_obsolete") == "true").alias("obsolete"),
        F.nullif(tag("replaced_by"), F.lit("")).alias("replaced_by"),
    ).where("id <> ''")
    return out.join(wanted.select("id").distinct(), "id", "left_semi") if wanted is not None else out


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """(gene_symbol, terms) of a tab-separated annotation file with those columns by name."""
    return spark.read.csv(path, sep="\t", header=True).groupBy("gene_symbol").agg(F.array_sort(F.collect_set("hpo_id")).alias("terms"))


def read_blocks(spark: SparkSession, path: str, **patterns: str) -> DataFrame:
    """Blank-line separated blocks of a text file, with the first group of each pattern as a column, null where it isn't found."""
    t = spark.read.option("lineSep", "\n\n").text(path).where(F.trim("value") != "")
    return t.select("value", *[F.nullif(F.regexp_extract("value", p, 1), F.lit("")).alias(n) for n, p in patterns.items()])


def slice_chapters(docs: DataFrame, key: str, text: str, separator: str, opening: Column) -> DataFrame:
    """(key, chapter, start, stop): each chapter from its first opening to where the next one starts; pages count from 1.

    ``opening`` is computed on ``line``; empty lines open nothing.
    """
    pages = docs.select(key, F.posexplode(F.split(F.col(text), separator)).alias("pos", "line"), F.size(F.split(F.col(text), separator)).alias("n"))
    first = pages.where("line <> ''").groupBy(key, opening.alias("chapter")).agg((F.min("pos") + 1).alias("start"), F.first("n").alias("n"))
    w = Window.partitionBy(key).orderBy("start", "chapter")
    return first.select(key, "chapter", "start", (F.coalesce(F.lead("start").over(w), F.col("n") + 1) - 1).alias("stop"))


def write_sharded(rows: DataFrame, key: str, path: str) -> None:
    """Sixteen folders by the first hex digit of the key's SHA-256, each deterministic JSON lines, compressed."""
    bucket = F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 1)
    rows.withColumn("bucket", bucket).repartition("bucket").sortWithinPartitions("bucket", key).write.partitionBy("bucket").option("compression", "gzip").json(path)


def read_sharded(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema + ", bucket string").json(path).drop("bucket")


def encode_records(rows: DataFrame, kind: str) -> DataFrame:
    """(seq, line): each row as an annotation line with its number and an unpadded URL-safe record; rows in order of their JSON."""
    body = numbered(rows.select(F.to_json(F.struct(*sorted(rows.columns))).alias("json")), "json", name="seq")
    return body.select("seq", F.concat(F.lit(f"record:{kind}:"), F.col("seq").cast("string"), F.lit(":"), to_base64url(F.encode("json", "UTF-8"))).alias("line"))


def decode_records(lines: DataFrame, kind: str, schema: str) -> DataFrame:
    """The rows of ``encode_records`` lines; a gap, a repeat or an unknown kind raises."""
    from signflow.functions.text import from_base64url

    p = lines.select(F.regexp_extract("line", r"^record:([^:]*):(\d+):(\S*)$", 1).alias("kind"), F.regexp_extract("line", r"^record:[^:]*:(\d+):", 1).cast("long").alias("seq"), F.regexp_extract("line", r":([^:]*)$", 1).alias("code"))
    n, least, most, distinct, odd = p.agg(F.count("*"), F.min("seq"), F.max("seq"), F.count_distinct("seq"), F.count_if(F.col("kind") != kind)).first()
    if odd or n and (least != 0 or most != n - 1 or distinct != n):
        raise ValueError(f"records are incomplete: {n} lines, {distinct} numbers from {least} to {most}, {odd} of another kind")
    return p.select(F.from_json(F.decode(from_base64url(F.col("code")), "UTF-8"), schema).alias("r")).select("r.*")


#: The relations of a map and the columns of their two ends and further values.
RELATIONS = {
    "Influence": ("source", "target", ("sign", "context")),
    "Production": ("source", "target", ("sign",)),
    "Constitution": ("micro", "macro", ("relation", "sign")),
    "Modulation": ("modulator", "influence_id", ("sign",)),
    "QuantitativeArgument": ("node", "result", ("kind", "role", "derivative_sign")),
}


def turtle(arcs: DataFrame, base: str = "http://example.org/") -> DataFrame:
    """(line) of reified influences (src, dst, m) in Turtle, one per arc, in order."""
    return triples({"Influence": arcs.select(F.col("src").alias("source"), F.col("dst").alias("target"), decode(F.col("m")).alias("sign"), F.lit(None).cast("string").alias("context"))}, base)


def triples(relations: dict[str, DataFrame], base: str = "http://example.org/") -> DataFrame:
    """(line) of reified relations in Turtle, one statement a row, in order; null values are left out."""
    from functools import reduce

    iri = lambda c: F.concat(F.lit(f"<{base}"), percent_encode(F.col(c).cast("string")), F.lit(">"))
    out = []
    for kind, df in relations.items():
        src, dst, values = RELATIONS[kind]
        parts = [F.concat(F.lit(f"[] a <{base}{kind}> ; <{base}{src}> "), iri(src), F.lit(f" ; <{base}{dst}> "), iri(dst))]
        parts += [F.coalesce(F.concat(F.lit(f' ; <{base}{v}> "'), escape_literal(F.col(v).cast("string")), F.lit('"')), F.lit("")) for v in values]
        out.append(df.select(F.concat(*parts, F.lit(" .")).alias("line")))
    return reduce(DataFrame.union, out).orderBy("line")


def map_relations(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """A map's collections by kind of relation."""
    args = tables["quantitative_definitions"].select("kind", "result", F.explode("arguments").alias("a")).select("kind", "result", F.col("a.node").alias("node"), F.col("a.role").alias("role"), F.col("a.derivative_sign").alias("derivative_sign"))
    return {"Influence": tables["causal_edges"], "Production": tables["production_edges"], "Constitution": tables["constitutive_edges"], "Modulation": tables["modulation_edges"], "QuantitativeArgument": args}


def owl(nodes: DataFrame, relations: dict[str, DataFrame], base: str = "http://example.org/") -> DataFrame:
    """(seq, line) of an ontology in functional syntax: declarations, labels, one existential axiom per relation, and each relation embedded as a record."""
    from functools import reduce

    iri = lambda c: F.concat(F.lit(f"<{base}"), percent_encode(F.col(c).cast("string")), F.lit(">"))
    lines = [
        nodes.select(F.lit(1).alias("part"), F.concat(F.lit("Declaration(Class("), iri("id"), F.lit("))")).alias("line")),
        nodes.select(F.lit(2).alias("part"), F.concat(F.lit("AnnotationAssertion(rdfs:label "), iri("id"), F.lit(' "'), escape_literal(F.col("label")), F.lit('")')).alias("line")),
    ]
    for kind, df in relations.items():
        src, dst, _ = RELATIONS[kind]
        lines.append(df.select(F.lit(3).alias("part"), F.concat(F.lit("SubClassOf("), iri(src), F.lit(f" ObjectSomeValuesFrom(<{base}{kind}> "), iri(dst), F.lit("))")).alias("line")))
        keep = [c for c in (src, dst, *RELATIONS[kind][2]) if c in df.columns]
        lines.append(encode_records(df.select(*keep), kind).select(F.lit(4).alias("part"), F.concat(F.lit('AnnotationAssertion(<urn:record> <urn:map> "'), "line", F.lit('")')).alias("line")))
    spark = nodes.sparkSession
    ends = spark.createDataFrame([(0, f"Ontology(<{base}>"), (5, ")")], "part int, line string")
    return numbered(reduce(DataFrame.unionByName, lines).distinct().unionByName(ends), "part", "line", name="seq").select("seq", "line")


def owl_records(lines: DataFrame, kind: str, schema: str) -> DataFrame:
    """The relations of a kind embedded in an ontology's lines; a gap or a repeat raises."""
    got = lines.select(F.regexp_extract("line", r'"(record:[^"]*)"', 1).alias("line")).where(F.startswith("line", F.lit(f"record:{kind}:")))
    return decode_records(got, kind, schema)


def owl_axioms(lines: DataFrame, kind: str, base: str = "http://example.org/") -> DataFrame:
    """(src, dst) of the asserted axioms of a kind, by which embedded records are witnessed."""
    p = rf"^SubClassOf\(<{base}([^>]*)> ObjectSomeValuesFrom\(<{base}{kind}> <{base}([^>]*)>\)\)$"
    g = lines.select(F.regexp_extract("line", p, 1).alias("src"), F.regexp_extract("line", p, 2).alias("dst")).where("src <> ''")
    return g.select(F.url_decode("src").alias("src"), F.url_decode("dst").alias("dst"))


def write_catalog(nodes: DataFrame, path: str) -> None:
    """The nodes in order of their id, as JSON lines and as a tab-separated table."""
    ordered = nodes.select("id", "label", "scale", "entity_iri", "quality_iri").repartitionByRange("id").sortWithinPartitions("id")
    ordered.write.json(f"{path}/json")
    ordered.write.option("sep", "\t").option("header", True).csv(f"{path}/tsv")


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of the files under a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def verify_checksums(spark: SparkSession, path: str, expected: DataFrame) -> DataFrame:
    """(name, problem) of files that are missing, unexpected or changed; ``expected`` has (name, sha256)."""
    have = checksums(spark, path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("sha256").alias("got"))
    j = expected.select("name", "sha256").join(have, "name", "full")
    problem = F.when(F.col("got").isNull(), "missing").when(F.col("sha256").isNull(), "unexpected").when(F.col("got") != F.col("sha256"), "changed")
    return j.select("name", problem.alias("problem")).where("problem is not null")


def workbook_rows(content: bytes) -> Iterator[tuple[int, int, dict[str, str]]]:
    """(sheet, row, cells) of a workbook's sheets, streamed; sheets and rows count from 1."""
    import io
    import re
    import zipfile
    from xml.etree import ElementTree

    text = lambda e: "".join(t.text or "" for t in e.iter() if t.tag.endswith("}t"))
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = [text(e) for e in ElementTree.parse(z.open("xl/sharedStrings.xml")).getroot()]
        sheets = sorted((int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(r"xl/worksheets/sheet(\d+)\.xml", n)))
        for k, sheet in sheets:
            place = 0
            for _, e in ElementTree.iterparse(z.open(sheet)):
                if not e.tag.endswith("}row"):
                    continue
                place = int(e.get("r") or place + 1)
                cells = {}
                for c in e:
                    value = next((v.text or "" for v in c if v.tag.endswith("}v")), None)
                    if c.get("t") == "s" and value is not None:
                        value = shared[int(value)]
                    elif c.get("t") == "inlineStr":
                        value = text(c)
                    elif c.get("t") == "b" and value is not None:
                        value = "TRUE" if value == "1" else "FALSE"
                    if value is not None:
                        cells[re.match("[A-Z]+", c.get("r"))[0]] = value
                yield k, place, cells
                e.clear()


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """(path, sheet, row, cells): the rows of workbooks' sheets, cells as a map from column letters to text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from itertools import batched

        for pdf in frames:
            for name, content in zip(pdf.path, pdf.content):
                for some in batched(workbook_rows(bytes(content)), 1000):
                    yield pd.DataFrame([(name, *r) for r in some], columns=["path", "sheet", "row", "cells"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, sheet int, row int, cells map<string, string>")


def with_header(sheet: DataFrame, names: list[str]) -> DataFrame:
    """A sheet's rows below its first as columns of the given names, found by that first row; a missing name raises."""
    head = sheet.where("row = 1").select("cells").first()
    letters = {v: k for k, v in (head.cells if head else {}).items()}
    if lost := [n for n in names if n not in letters]:
        raise ValueError(f"the sheet has no columns {lost}")
    return sheet.where("row > 1").select("row", *[F.col("cells")[letters[n]].alias(n) for n in names])


def read_xpt(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Columns of SAS transport files (a path with wildcards) of one table each, by name and type."""
    from functools import reduce

    from signflow.sources.transport import read_transport

    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where)
    if not found:
        raise FileNotFoundError(path)
    columns = [F.col(c.split()[0]).cast(c.split()[1]).alias(c.split()[0]) for c in schema.split(", ")]
    return reduce(DataFrame.unionByName, [read_transport(spark, f.getPath().toString()).select(*columns) for f in found])


def cached_terms(spark: SparkSession, cache: str, sources: DataFrame, wanted: DataFrame) -> DataFrame | None:
    """The cached terms, if they were made from sources of these checksums (name, sha256) and hold all wanted ids (id); else None."""
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{cache}/sources")
    if not jvm.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm):
        return None
    if stale(sources.select("name", "sha256"), spark.read.parquet(f"{cache}/sources").select("name", "sha256")):
        return None
    terms = spark.read.parquet(f"{cache}/terms")
    return None if not wanted.select("id").join(terms.select("id"), "id", "left_anti").isEmpty() else terms


def cache_terms(cache: str, sources: DataFrame, terms: DataFrame) -> None:
    """Terms and then the checksums they were made from; without checksums there is no cache."""
    terms.write.mode("overwrite").parquet(f"{cache}/terms")
    sources.select("name", "sha256").write.mode("overwrite").parquet(f"{cache}/sources")


def to_fetch(wanted: DataFrame, cache: DataFrame, key: str, batch: int) -> DataFrame:
    """(key, batch): what a cache lacks, numbered in batches for a fetch."""
    lacking = wanted.select(key).where(F.col(key).isNotNull()).distinct().join(cache.select(key), key, "left_anti")
    return numbered(lacking, key).select(key, F.floor(F.col("number") / batch).alias("batch"))


def trace_pages(traces: DataFrame) -> DataFrame:
    """(path, html): one page per intervention, with the traces (iv_id, node, paths, net) of its targets in order."""
    from signflow.functions.text import slugify

    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    item = F.concat(F.lit("<h2>"), esc(F.col("node").cast("string")), F.lit(" "), decode(F.col("net")), F.lit("</h2><ol>"), F.array_join(F.transform("paths", lambda p: F.concat(F.lit("<li>"), esc(p), F.lit("</li>"))), ""), F.lit("</ol>"))
    page = traces.groupBy("iv_id").agg(F.array_sort(F.collect_list(F.struct("node", item.alias("item")))).alias("items"))
    name = F.concat(slugify(F.col("iv_id").cast("string")), F.lit(".html"))
    return page.select(name.alias("path"), F.concat(F.lit("<!doctype html><title>"), esc(F.col("iv_id").cast("string")), F.lit("</title>"), F.array_join(F.transform("items", lambda x: x.item), "")).alias("html"))


def stale_pages(pages: DataFrame, published: DataFrame) -> DataFrame:
    """(path, problem) of pages that are missing, left over or changed."""
    j = pages.select("path", F.col("html").alias("new")).join(published.select("path", F.col("html").alias("old")), "path", "full")
    problem = F.when(F.col("old").isNull(), "missing").when(F.col("new").isNull(), "left over").when(F.col("old") != F.col("new"), "changed")
    return j.select("path", problem.alias("problem")).where("problem is not null")


def payload_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(bucket, bytes) of a sharded payload as stored, and all together (bucket null), for a budget."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(path)
    return files.select(F.regexp_extract("path", "bucket=([0-9a-f])", 1).alias("bucket"), "length").rollup("bucket").agg(F.sum("length").alias("bytes"))


def write_report(rows: DataFrame, path: str, kind: str = "json") -> None:
    """A small report in the order of its columns: json, csv, tsv, parquet, or md and tex as one table of text."""
    flat = rows.select(*[F.col(c).cast("string").alias(c) for c in rows.columns])
    if kind in ("md", "tex"):
        sep, end = (" | ", "") if kind == "md" else (" & ", r" \\")
        body = flat.select(F.concat_ws(sep, *[F.coalesce(c, F.lit("")) for c in flat.columns]).alias("value")).orderBy("value")
        head = [sep.join(flat.columns)] + ([sep.join("---" for _ in flat.columns)] if kind == "md" else [])
        top = rows.sparkSession.createDataFrame([(i, x) for i, x in enumerate(head)], "i int, value string")
        # a report is a table to be read; its lines are one file
        lines = top.unionByName(body.select(F.lit(len(head)).alias("i"), "value")).orderBy("i", "value").select(F.concat("value", F.lit(end)).alias("value"))
        lines.coalesce(1).write.text(path)
    elif kind in ("csv", "tsv"):
        rows.orderBy(*rows.columns).write.option("header", True).option("sep", "," if kind == "csv" else "\t").csv(path)
    else:
        rows.orderBy(*rows.columns).write.format(kind).save(path)


def stale(rows: DataFrame, published: DataFrame) -> bool:
    """Whether a published table differs from what it should hold now, repeats counted."""
    return not (rows.exceptAll(published).isEmpty() and published.exceptAll(rows).isEmpty())
