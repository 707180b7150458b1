"""From facets to documents: identity, title, content, sections, metadata, references, context.

Everything is a column expression over the node arrays of one document, built from the source's role
table; nothing is exploded, so parsing does not shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.sources import xml as X
from corpusloom.sources.tables import TABLES, RoleTable

VERSION_KIND, HEURISTIC_KIND = "version", "unconfigured:dila_id"
#: Reasons for which something is left out of a run.
PARSE_ERROR, VALIDATION_ERROR, COLLISION, EXPORT_ARTIFACT, UNREADABLE = "parse_error", "validation_error", "collision", "export_artifact", "unreadable"


def _isin(column: Column, values) -> Column:
    return F.array_contains(F.array(*map(F.lit, sorted(values))), column) if values else F.lit(False)


def _lookup(mapping, key: Column) -> Column:
    if not mapping:
        return F.lit(None).cast("string")
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in mapping.items() for x in pair)), key)


def _first(values: Column) -> Column:
    return F.try_element_at(values, F.lit(1))


def _first_text(facets: Column, tag: str) -> Column:
    """The stripped text of the first facet whose first node of the tag has one."""
    texts = F.transform(facets, lambda f: T.strip(X.first_of(f.nodes, tag).text))
    return _first(F.filter(texts, lambda t: t.isNotNull() & (t != "")))


def ordered_facets(facets: Column, table: RoleTable) -> Column:
    """By the rank of their roots; a single facet as it is."""
    roots = F.array(*map(F.lit, table.roots))
    return F.array_sort(facets, lambda a, b: F.array_position(roots, a.root).cast("int") - F.array_position(roots, b.root).cast("int"))


def facets_ordered(facets: Column, table: RoleTable) -> Column:
    """Whether an order exists: one facet, or declared roots without repeats."""
    roots = F.transform(facets, lambda f: f.root)
    declared = F.size(F.array_except(roots, F.array(*map(F.lit, table.roots)))) == 0
    return (F.size(facets) <= 1) | ((F.size(F.array_distinct(roots)) == F.size(roots)) & declared)


def text_blocks(facets: Column, table: RoleTable) -> Column:
    """array<struct<path, text>> of the non-blank texts, facet by facet, block tag by block tag, block by block, holder by holder."""

    def holders(nodes: Column, block: Column) -> Column:
        out = F.array(block)
        for tag in reversed(table.text_holders):
            found = X.all_of(nodes, tag, block)
            out = F.when(F.size(found) > 0, found).otherwise(out)
        return out

    def of_tag(f: Column, tag: str) -> Column:
        path = F.array(f.root, F.lit(tag)).alias("path")
        return F.flatten(F.transform(X.all_of(f.nodes, tag), lambda b: F.transform(holders(f.nodes, b), lambda h: F.struct(path, F.coalesce(h.flat, F.lit("")).alias("text")))))

    def of_facet(f: Column) -> Column:
        return F.concat(*(of_tag(f, tag) for tag in table.content_blocks))

    return F.filter(F.flatten(F.transform(facets, of_facet)), lambda b: T.strip(b.text) != "")


def _occurrence(key: Column, value: Column, file: Column, unconfigured: Column) -> Column:
    return F.struct(key.alias("key"), value.alias("value"), file.alias("file"), unconfigured.alias("unconfigured"))


def metadata_leaves(facets: Column, table: RoleTable) -> Column:
    """Non-blank leaves of a metadata role under the meta container; the key is the renamed tag, else the path."""

    def leaf(f: Column, n: Column) -> Column:
        rename = _lookup(table.renames, n.tag)
        return _occurrence(F.coalesce(rename, X.path_key(n)), T.strip(n.text), f.file, rename.isNull())

    def of_facet(f: Column) -> Column:
        inside = F.transform(X.all_of(f.nodes, table.meta_container), lambda m: F.filter(f.nodes, lambda n: n.pre.between(m.pre, m.post) & n.leaf & (T.strip(n.text) != "") & _isin(n.tag, table.collectable)))
        return F.transform(F.flatten(inside), lambda n: leaf(f, n))

    return F.flatten(F.transform(facets, of_facet))


def unknown_values(facets: Column, table: RoleTable) -> Column:
    """array<struct<key, value, file, tag>> of nodes that the table does not know: attributes first, then a leaf's text."""

    def of_node(f: Column, n: Column) -> Column:
        attrs = F.transform(F.filter(F.map_entries(n.attrs), lambda e: T.strip(e.value) != ""), lambda e: F.struct(F.concat(X.path_key(n), F.lit("_"), F.lower(e.key)).alias("key"), T.strip(e.value).alias("value"), f.file.alias("file"), n.tag.alias("tag")))
        own = F.struct(X.path_key(n).alias("key"), T.strip(n.text).alias("value"), f.file.alias("file"), n.tag.alias("tag"))
        return F.concat(attrs, F.when(n.leaf & (T.strip(n.text) != ""), F.array(own)).otherwise(F.array_remove(F.array(own), own)))

    return F.flatten(F.transform(facets, lambda f: F.flatten(F.transform(F.filter(f.nodes, lambda n: ~_isin(n.tag, table.known)), lambda n: of_node(f, n)))))


def _reference(kind: Column, identifier: Column, typelien=None, sens=None, label=None, tag=None, dating=None) -> Column:
    empty = F.lit("")
    none = F.map_filter(F.create_map(F.lit(""), F.lit("")), lambda k, v: F.lit(False))
    return F.struct(
        kind.alias("kind"), identifier.alias("id"), (empty if typelien is None else typelien).alias("typelien"), (empty if sens is None else sens).alias("sens"),
        (empty if label is None else label).alias("label"), (empty if tag is None else tag).alias("tag"), (none if dating is None else dating).alias("dating"),
    )


def references(facets: Column, table: RoleTable) -> Column:
    """Facet by facet: declared links, structural links in their containers, version links with their dating."""

    def label(n: Column) -> Column:
        return T.normalize_composed(n.flat)

    def of_facet(f: Column) -> Column:
        declared = [F.transform(X.all_of(f.nodes, tag), lambda n: _reference(n.tag, X.attr(n, "id"), X.attr(n, "typelien"), X.attr(n, "sens"), label(n))) for tag in table.link_tags]
        structural = F.transform(X.nested(f.nodes, table.structural_containers, table.structural_tags), lambda n: _reference(n.tag, X.attr(n, "id"), label=label(n)))
        versions = F.transform(X.nested(f.nodes, table.version_containers, table.version_tags), lambda n: _reference(F.lit(VERSION_KIND), X.attr(n, "id"), dating=F.map_filter(n.attrs, lambda k, v: (k != "id") & (T.strip(v) != ""))))
        return F.concat(*declared, structural, versions)

    return F.flatten(F.transform(facets, of_facet))


def context(facets: Column, table: RoleTable) -> Column:
    """Ancestors with an identifier: array<struct<kind, id, label>>."""

    def ancestor(n: Column) -> Column:
        return F.struct(n.tag.alias("kind"), T.first_non_empty(*(X.attr(n, a) for a in table.ancestor_ids)).alias("id"), T.normalize_composed(n.text).alias("label"))

    found = F.flatten(F.transform(facets, lambda f: F.transform(X.nested(f.nodes, table.ancestor_containers, table.ancestor_tags), ancestor)))
    return F.filter(found, lambda a: a.id != "")


def resolve(occurrences: Column, list_keys) -> Column:
    """array<struct<key, is_list, vals, seen>>: distinct values of each key in first-seen order; seen keeps all with their files."""

    def of_key(k: Column) -> Column:
        mine = F.filter(occurrences, lambda o: o.key == k)
        vals = F.array_distinct(F.transform(mine, lambda o: o.value))
        return F.struct(k.alias("key"), (_isin(k, list_keys) | (F.size(vals) > 1)).alias("is_list"), vals.alias("vals"), F.transform(mine, lambda o: F.struct(o.value.alias("value"), o.file.alias("source_file"))).alias("seen"))

    return F.transform(F.array_distinct(F.transform(occurrences, lambda o: o.key)), of_key)


def _files_by_key(pairs: Column) -> Column:
    """map of key to the first file that has it, from array<struct<key, file>>."""
    keys = F.array_distinct(F.transform(pairs, lambda p: p.key))
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(k.alias("key"), _first(F.filter(pairs, lambda p: p.key == k)).file.alias("file"))))


def parse(raw: DataFrame, source: str) -> DataFrame:
    """One row for each raw document of the source, refused ones too (reject says why; null: accepted)."""
    table = TABLES[source]
    df = raw.where(F.col("source") == source).withColumn("fine", facets_ordered(F.col("facets"), table)).withColumn("facets", ordered_facets(F.col("facets"), table))
    facets = F.col("facets")
    df = df.withColumn("identifier", _first_text(facets, table.identifier_tag))
    df = df.withColumn("unknown", unknown_values(facets, table))

    def heuristic(u: Column) -> Column:
        return T.is_identifier(u.value) & ~u.value.contains("\n") & (u.value != F.coalesce(F.col("identifier"), F.lit("")))

    df = df.withColumn("guessed", F.filter("unknown", heuristic))
    stray = F.transform(F.filter("unknown", lambda u: ~heuristic(u)), lambda u: _occurrence(u.key, u.value, u.file, F.lit(True)))
    df = df.withColumn("occurrences", F.concat(metadata_leaves(facets, table), stray))
    df = df.withColumn("resolved", resolve(F.col("occurrences"), table.list_keys))
    collisions = F.transform(F.filter("resolved", lambda r: F.size(r.vals) > 1), lambda r: F.struct(r.key.alias("key"), r.seen.alias("values")))
    blocking = F.exists("resolved", lambda r: (F.size(r.vals) > 1) & _isin(r.key, set(table.renames.values()) - table.list_keys))
    kind = _lookup(table.prefixes, F.substring("identifier", 1, 8))
    reject = (
        F.when(F.size(facets) == 0, PARSE_ERROR)
        .when(~F.col("fine") | F.col("identifier").isNull() | ~T.is_identifier(F.col("identifier")) | kind.isNull(), VALIDATION_ERROR)
        .when(blocking, COLLISION)
    )
    nature = F.upper(_first_text(facets, table.nature_tag))
    title = F.coalesce(*(_first_text(facets, t) for t in table.title_tags), F.lit(""))
    df = df.withColumn("blocks", text_blocks(facets, table))
    return df.select(
        "source",
        "doc_key",
        "identifier",
        kind.alias("document_type"),
        F.when(~_isin(nature, table.uninformative_natures), nature).alias("nature"),
        T.normalize_text(title).alias("title"),
        T.normalize_composed(F.array_join(F.transform("blocks", lambda b: b.text), "\n\n")).alias("content"),
        F.transform("blocks", lambda b: F.struct(b.path.alias("path"), T.normalize_composed(b.text).alias("text"))).alias("sections"),
        F.map_from_entries(F.transform("resolved", lambda r: F.struct(r.key.alias("key"), F.struct(r.is_list.alias("is_list"), r.vals.alias("vals")).alias("value")))).alias("metadata"),
        F.concat(references(facets, table), F.transform("guessed", lambda u: _reference(F.lit(HEURISTIC_KIND), u.value, tag=u.tag))).alias("references"),
        context(facets, table).alias("context"),
        F.transform(facets, lambda f: f.file).alias("source_files"),
        _files_by_key(F.transform(F.filter("occurrences", lambda o: o.unconfigured), lambda o: F.struct(o.key.alias("key"), o.file.alias("file")))).alias("unconfigured_tags"),
        _files_by_key(F.transform("guessed", lambda u: F.struct(u.key.alias("key"), u.file.alias("file")))).alias("unconfigured_links"),
        _files_by_key(F.transform(F.filter(facets, lambda f: ~_isin(f.root, table.roots)), lambda f: F.struct(f.root.alias("key"), f.file.alias("file")))).alias("unknown_roots"),
        collisions.alias("collisions"),
        reject.alias("reject"),
    )


def parse_all(raw: DataFrame, sources: list[str]) -> DataFrame:
    """parse() of each source. A row of another source is an error when the query runs."""
    wrong = F.raise_error(F.concat(F.lit("no parser for the source "), F.coalesce("source", F.lit("null")))).cast("string")
    raw = raw.withColumn("source", F.when(F.col("source").isin(*sources), F.col("source")).otherwise(wrong))
    return reduce(DataFrame.unionByName, (parse(raw, s) for s in sources))


def accepted(parsed: DataFrame, skip_unconfigured: bool = False) -> DataFrame:
    """The documents, after signals and collisions have been read from `parsed`; unconfigured metadata is left out on request."""
    docs = parsed.where("reject is null")
    if skip_unconfigured:
        docs = docs.withColumn("metadata", F.map_filter("metadata", lambda k, v: ~F.map_contains_key("unconfigured_tags", k)))
    return docs


def unknown_signals(parsed: DataFrame) -> DataFrame:
    """category (tags, links, roots), value, identifier, source_file: each once a document, of refused documents too."""
    who = F.coalesce("identifier", "doc_key").alias("identifier")
    branches = [parsed.select(F.lit(category).alias("category"), who, F.explode(column).alias("value", "source_file")) for category, column in (("tags", "unconfigured_tags"), ("links", "unconfigured_links"), ("roots", "unknown_roots"))]
    return reduce(DataFrame.unionByName, branches)


def collision_signals(parsed: DataFrame) -> DataFrame:
    """source, identifier, key, files of each collision, of refused documents too."""
    return parsed.select("source", "identifier", F.explode("collisions").alias("c")).select("source", "identifier", "c.key", F.transform("c.values", lambda v: v.source_file).alias("files"))
