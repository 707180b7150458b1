"""Scan of XML files into a table of facets, each with its tree as a flat array of nodes.

A tree is an interval encoding: `pre` numbers the nodes in document order and `post` is the last
number in a node's subtree, so containment is a range test inside one row. Only decoding XML is
Python; what a document means is read from the nodes with Spark columns.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import reduce
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.sources.tables import FACETED, RoleTable, table_of

NODE = "struct<pre:int,post:int,depth:int,leaf:boolean,tag:string,path:array<string>,attrs:map<string,string>,text:string,flat:string>"
FACET = f"path string, root string, raw_id string, nodes array<{NODE}>, error string, failure struct<type:string,message:string>"
_ARROW_NODE = pa.struct(
    [("pre", pa.int32()), ("post", pa.int32()), ("depth", pa.int32()), ("leaf", pa.bool_()), ("tag", pa.string()), ("path", pa.list_(pa.string())), ("attrs", pa.map_(pa.string(), pa.string())), ("text", pa.string()), ("flat", pa.string())]
)
_ARROW_FACET = pa.schema([("path", pa.string()), ("root", pa.string()), ("raw_id", pa.string()), ("nodes", pa.list_(_ARROW_NODE)), ("error", pa.string()), ("failure", pa.struct([("type", pa.string()), ("message", pa.string())]))])


def flat_text(element: ElementTree.Element, transparent: dict[str, str]) -> str:
    """Text through transparent tags only, each followed by its separator; tails of all children; joined by spaces; in NFC."""
    parts: list[str] = []
    todo: list = [element]
    while todo:
        item = todo.pop()
        if isinstance(item, str):
            parts.append(item)
            continue
        if (item.text or "").strip():
            parts.append(item.text.strip())
        later: list = []
        for child in item:
            if child.tag in transparent:
                later += [child, transparent[child.tag]]
            if (child.tail or "").strip():
                later.append(child.tail.strip())
        todo += reversed(later)
    return unicodedata.normalize("NFC", " ".join(parts))


def nodes_of(root: ElementTree.Element, read: frozenset[str], transparent: dict[str, str]) -> list[dict]:
    """The nodes in document order; flat is filled for the tags in `read`."""
    out: list[dict] = []
    todo: list = [(root, (root.tag,))]
    while todo:
        item, path = todo.pop()
        if path is None:
            item["post"] = len(out) - 1
            continue
        node = {"pre": len(out), "post": 0, "depth": len(path) - 1, "leaf": len(item) == 0, "tag": item.tag, "path": list(path), "attrs": list(item.attrib.items()), "text": item.text or "", "flat": flat_text(item, transparent) if item.tag in read else None}
        out.append(node)
        todo.append((node, None))
        todo += [(child, (*path, child.tag)) for child in reversed(item)]
    return out


def _read_tags(table: RoleTable) -> frozenset[str]:
    return frozenset({*table.content_blocks, *table.text_holders, *table.link_tags, *table.structural_tags})


def _decode(table: RoleTable):
    read, transparent = _read_tags(table), dict(table.transparent)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist(), strict=True):
                try:
                    root = ElementTree.fromstring(content or b"")
                    nodes = nodes_of(root, read, transparent)
                    first = next((n["text"].strip() for n in nodes if n["tag"] == table.identifier_tag), "")
                    rows.append({"path": path, "root": root.tag, "raw_id": first or None, "nodes": nodes})
                except ElementTree.ParseError as broken:
                    rows.append({"path": path, "error": str(broken)})
                except Exception as broken:  # noqa: BLE001  as of an encoding that the reader does not know: this file fails, the others do not
                    rows.append({"path": path, "failure": {"type": type(broken).__name__, "message": str(broken)[:200]}})
            yield pa.RecordBatch.from_pylist(rows, _ARROW_FACET)

    return decode


def scan_files(spark: SparkSession, path: str) -> DataFrame:
    """All *.xml files below a folder: path, content."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.xml").load(path).select("path", "content")


def decode_facets(files: DataFrame, source: str) -> DataFrame:
    """source, path, root, raw_id, nodes, error, failure, skip (null, 'unreadable', 'failed' or 'export_artifact'). files: path, content."""
    out = files.select("path", "content").mapInArrow(_decode(table_of(source)), FACET)
    name = F.element_at(F.split("path", "/"), -1)
    artefact = (name == "versions.xml") & F.col("root").isin("VERSIONS", "ID") if source in FACETED else F.lit(False)
    skip = F.when(F.col("error").isNotNull(), "unreadable").when(F.col("failure").isNotNull(), "failed").when(artefact, "export_artifact")
    return out.select(F.lit(source).alias("source"), "*", skip.alias("skip"))


def scan(spark: SparkSession, root: str, sources: list[str]) -> DataFrame:
    """The facets of several sources, each in the folder of its name below root."""
    if not sources:
        raise ValueError("no source to read")
    return reduce(DataFrame.unionByName, (decode_facets(scan_files(spark, f"{root}/{s}"), s) for s in sources))


def skipped(facets: DataFrame) -> DataFrame:
    """source, skip, count."""
    return facets.where("skip is not null").groupBy("source", "skip").count()


def failures(facets: DataFrame) -> DataFrame:
    """identifier (the file's path), phase, type, message of files that could not be taken apart, though they may be well-formed."""
    return facets.where("skip = 'failed'").select(F.col("path").alias("identifier"), F.lit("decode").alias("phase"), "failure.type", "failure.message")


def _doc_key() -> Column:
    return F.when(F.col("source").isin(*FACETED), F.coalesce("raw_id", "path")).otherwise(F.col("path"))


def fetched(facets: DataFrame) -> DataFrame:
    """source, doc_key of each document that the files hold, counted at the scan and not from what came of it."""
    return facets.where("skip is null OR skip = 'failed'").select("source", _doc_key().alias("doc_key")).distinct()


def raw_documents(facets: DataFrame) -> DataFrame:
    """source, doc_key, facets array<struct<file, root, nodes>> in the order of their paths' parts.

    Facets of one located id are one document where the source has facets; without an id, a file stands alone.
    """
    kept, key = facets.where("skip is null"), _doc_key()
    parts = F.split("path", "/")
    grouped = kept.groupBy("source", key.alias("doc_key")).agg(F.array_sort(F.collect_list(F.struct(parts.alias("parts"), F.col("path").alias("file"), "root", "nodes")), _by_parts).alias("facets"))
    return grouped.withColumn("facets", F.transform("facets", lambda f: F.struct(f.file.alias("file"), f.root.alias("root"), f.nodes.alias("nodes"))))


def _by_parts(a: Column, b: Column) -> Column:
    return F.when(a.parts < b.parts, -1).when(a.parts > b.parts, 1).otherwise(0)


def attr(node: Column, name: str) -> Column:
    """An attribute, '' if it is missing."""
    return F.coalesce(F.try_element_at(node.attrs, F.lit(name)), F.lit(""))


def all_of(nodes: Column, tag: str, within: Column | None = None) -> Column:
    """The nodes of a tag, in document order, below and including `within`."""
    if within is None:
        return F.filter(nodes, lambda n: n.tag == tag)
    return F.filter(nodes, lambda n: (n.tag == tag) & n.pre.between(within.pre, within.post))


def first_of(nodes: Column, tag: str) -> Column:
    return F.try_element_at(all_of(nodes, tag), F.lit(1))


def nested(nodes: Column, containers: tuple[str, ...], tags: tuple[str, ...]) -> Column:
    """Nodes of the tags inside the containers: container tag by container tag, node by node, tag by tag; nested containers repeat them."""
    steps = [F.flatten(F.transform(all_of(nodes, c), lambda parent: F.concat(*(all_of(nodes, t, parent) for t in tags)))) for c in containers]
    return F.concat(*steps) if steps else F.filter(nodes, lambda n: F.lit(False))


def path_key(node: Column) -> Column:
    return F.lower(F.array_join(node.path, "_"))
