"""Documents from folders, lists and tables; control files; topics."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphgrove.operators.documents import parse_formula
from glyphgrove.parse import markup


def list_folder(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, doc_name, ext, n_bytes``: files below a folder, numbered by name from 0; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")
    return _numbered(files.select(F.col("path").alias("doc_name"), F.col("length").alias("n_bytes")))


def _numbered(files: DataFrame) -> DataFrame:
    """Dense ids in the order of names: rows are range-partitioned by name, and only partition sizes meet."""
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in files.schema)
    rows = files.sort("doc_name").rdd.zipWithIndex().map(lambda x: (x[1], *x[0]))
    out = files.sparkSession.createDataFrame(rows, f"doc_id bigint, {kinds}")
    return out.withColumn("ext", F.lower(F.regexp_extract("doc_name", r"\.([^./]+)\z", 1)))


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, doc_name, ext`` of a list with one file name per line; ids follow the sorted names."""
    names = spark.read.text(path).select(F.trim("value").alias("doc_name")).filter("doc_name <> ''")
    return _numbered(names)


def read_contents(docs: DataFrame) -> DataFrame:
    """Adds ``content`` (UTF-8, damaged bytes replaced), read where the tasks run; null for files that aren't there."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from glyphgrove.operators.small_files import _open_fs

        for batch in batches:
            texts = []
            for name in batch["doc_name"]:
                try:
                    fs, place = _open_fs(name.removeprefix("file:") if name.startswith("file:/") else name)
                    with fs.open_input_stream(place) as f:
                        texts.append(f.read().decode("utf-8", errors="replace"))
                except OSError:
                    texts.append(None)
            yield batch.assign(content=texts)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInPandas(read, f"{kinds}, content string")


def names_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``doc_id, doc_name`` of the documents in ``ids`` (``doc_id``), each once."""
    return docs.select("doc_id", "doc_name").join(ids.select("doc_id").distinct(), "doc_id", "left_semi")


def fetch_formulas(scanned: DataFrame, places: DataFrame) -> DataFrame:
    """``doc_id, position, formula`` of scanned formulas at ``places`` (``doc_id, position``)."""
    return scanned.join(places.select("doc_id", "position").distinct(), ["doc_id", "position"], "left_semi")


def read_formula_table(spark: SparkSession, path: str, *, ident: int = 0, formula: int = 5) -> DataFrame:
    """``doc_id, doc_name, content`` of a tab-separated table with a formula in markup per row; kept as a table, not as files."""
    raw = spark.read.option("sep", "\t").option("header", True).option("quote", '"').option("escape", '"').option("multiLine", False).csv(path)
    return raw.select(F.col(raw.columns[ident]).cast("bigint").alias("doc_id"), F.col(raw.columns[ident]).alias("doc_name"), F.col(raw.columns[formula]).alias("content"))


def read_control(spark: SparkSession, path: str) -> dict[str, str]:
    """Key and value of each line of a control file, a configuration of a few keys; all its lines are read."""
    lines = spark.read.text(path).select(F.split("value", "\t", 2).alias("p")).filter("size(p) = 2").collect()
    return {r["p"][0]: r["p"][1] for r in lines}


def topics(text: str, *, operator: bool = False) -> tuple[list[tuple[str, int, str]], list[tuple[str, str]]]:
    """Formulas ``(query, number, expr)`` and keywords ``(query, term)`` of a topics file, read leniently."""
    formulas: list[tuple[str, int, str]] = []
    keywords: list[tuple[str, str]] = []
    root = markup.read(text)
    for t in _all(root, "topic"):
        num = t.find("num")
        name = (num.text if num is not None else t.attrib.get("id", "")).strip()
        keywords += [(name, k.text.strip()) for k in _all(t, "keyword") if k.text.strip()]
    pieces = re.split(r"(?i)<(?:[^>\s:]*:)?topic(?=[\s>])", text)[1:]
    for t, piece in zip(_all(root, "topic"), pieces, strict=False):
        num = t.find("num")
        name = (num.text if num is not None else t.attrib.get("id", "")).strip()
        found = [parse_formula(f, operator=operator) for f in markup.formulas(piece)]
        formulas += [(name, i, e) for i, e in enumerate(found) if e]
    return formulas, keywords


def _all(e: markup.Element, tag: str) -> list[markup.Element]:
    out = []
    for c in e.children:
        out += [c] if c.tag == tag else _all(c, tag)
    return out


def read_topics(spark: SparkSession, path: str, *, operator: bool = False) -> tuple[DataFrame, DataFrame]:
    """Queries ``query_id, expr_no, expr`` and keywords ``query_id, term`` of topics files (one file is one task)."""
    files = spark.read.option("wholetext", True).text(path)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text in batch["value"]:
                f, k = topics(text, operator=operator)
                out += [(q, i, e, None) for q, i, e in f] + [(q, None, None, w) for q, w in k]
            yield pd.DataFrame(out, columns=["query_id", "expr_no", "expr", "term"]).astype({"expr_no": "Int64"})

    all_rows = files.mapInPandas(rows, "query_id string, expr_no int, expr string, term string")
    return all_rows.filter("expr IS NOT NULL").drop("term"), all_rows.filter("term IS NOT NULL").select("query_id", "term")


def build_topics(topics_rows: list[tuple[str, list[str], list[str]]]) -> str:
    """Topics file of (name, formulas in markup, keywords)."""
    root = ET.Element("topics")
    for name, formulas, words in topics_rows:
        t = ET.SubElement(root, "topic")
        ET.SubElement(t, "num").text = name
        q = ET.SubElement(t, "query")
        for i, f in enumerate(formulas):
            e = ET.SubElement(q, "formula", id=f"f.{i}")
            e.append(ET.fromstring(f))
        for i, w in enumerate(words):
            ET.SubElement(q, "keyword", id=f"w.{i}").text = w
    return ET.tostring(root, encoding="unicode")
