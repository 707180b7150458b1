"""Links of a document: typed, structural, ancestor, version and guessed edges, and what cannot be one.

All of it stays inside a row until the edges are exploded; no join is needed, as the version chain and
its as-of anchor are lookups in the document's own sorted list.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators.parsing import HEURISTIC_KIND, VERSION_KIND, _isin, _lookup
from corpusloom.sources.tables import TABLES, RoleTable

CONTIENT, SUIVI_PAR, STILLBORN = "contient", "suivi_par", "_MORT_NE"
#: The verbs whose meaning is known.
CANONICAL_VERBS = ("cite", "modifie", "abroge", "cree", "source", "codifie", "concorde", "applique_spec", "applique", "associe", "transfere", "deplace", CONTIENT, SUIVI_PAR)
EDGE = "struct<src:string,dst:string,type:string,props:map<string,string>>"


def translate(table: RoleTable, raw: Column) -> tuple[Column, Column]:
    """(verb or null, whether the table has the word)."""
    word = _lookup(table.verbs, raw)
    return F.coalesce(word, T.verb_of(raw)), word.isNotNull()


def _edge(src: Column, dst: Column, verb: Column, props: Column) -> Column:
    held = F.map_filter(props, lambda k, v: v.isNotNull() & (v != ""))
    return F.struct(src.alias("src"), dst.alias("dst"), verb.alias("type"), held.alias("props"))


def _props(**values: Column) -> Column:
    return F.create_map(*(x for k, v in values.items() for x in (F.lit(k), v)))


def version_edges(me: Column, references: Column) -> Column:
    """Edges before and after me in the chain of versions, and those of stillborn ones to the version in force."""
    entries = F.filter(references, lambda r: (r.kind == VERSION_KIND) & T.is_identifier(r.id))

    def date(e: Column, name: str) -> Column:
        return F.coalesce(F.try_element_at(e.dating, F.lit(name)), F.lit(""))

    def stillborn(e: Column) -> Column:
        return F.endswith(date(e, "etat"), F.lit(STILLBORN))

    def order(a: Column, b: Column) -> Column:
        x, y = (F.struct(date(e, "debut"), date(e, "fin"), e.seq) for e in (a, b))
        return F.when(x < y, -1).when(x > y, 1).otherwise(0)

    numbered = F.transform(entries, lambda e, i: F.struct(e.id.alias("id"), e.dating.alias("dating"), i.alias("seq")))
    living = F.array_sort(F.filter(numbered, lambda e: ~stillborn(e)), order)
    dead = F.filter(numbered, stillborn)

    def at(array: Column, i: Column) -> Column:
        return F.when(i >= 1, F.try_element_at(array, i))

    def anchor(debut: Column) -> Column:
        return F.try_element_at(F.filter(living, lambda e: date(e, "debut") < debut), F.lit(-1))

    here = F.array_position(F.transform(living, lambda e: e.id), me).cast("int")
    verb = F.lit(SUIVI_PAR)
    before = F.when(here > 1, _edge(at(living, here - 1).id, me, verb, at(living, here).dating))
    after = F.when((here > 0) & (here < F.size(living)), _edge(me, at(living, here + 1).id, verb, at(living, here + 1).dating))
    branches = F.transform(dead, lambda d: F.when(anchor(date(d, "debut")).id == me, _edge(me, d.id, verb, d.dating)))
    mine = F.try_element_at(F.filter(dead, lambda d: d.id == me), F.lit(1))
    into = F.when(mine.isNotNull() & anchor(date(mine, "debut")).isNotNull(), _edge(anchor(date(mine, "debut")).id, me, verb, mine.dating))
    found = F.when(here > 0, F.concat(F.array(before, after), branches)).otherwise(F.array(into))
    return F.filter(found, lambda e: e.isNotNull())


def with_links(docs: DataFrame, source: str) -> DataFrame:
    """docs (identifier, source, references, context) of one source, with `links`: struct of edges, unconfigured, unformatted, lost, unknown_words."""
    table = TABLES[source]
    df = docs.where(F.col("source") == source)
    me = F.col("identifier")

    def typed(r: Column) -> Column:
        verb, known = translate(table, r.typelien)
        fine = T.is_identifier(r.id)
        structural = fine & _isin(r.kind, table.structural_tags)
        source_end, target_end = F.when(r.sens == "cible", r.id).otherwise(me), F.when(r.sens == "cible", me).otherwise(r.id)
        oriented = r.sens.isin("source", "cible")
        is_typed = fine & ~structural
        label = T.strip(r.label)
        return F.struct(
            F.when(structural, _edge(me, r.id, F.lit(CONTIENT), _props(kind=r.kind))).when(is_typed & verb.isNotNull() & oriented, _edge(source_end, target_end, verb, _props(typelien=r.typelien, sens=r.sens))).alias("edge"),
            (structural | known).alias("configured"),
            F.when(~fine & (label != ""), F.struct(label.alias("target_text"), F.coalesce(verb, r.typelien).alias("relation_type"), r.sens.alias("sens"))).alias("unformatted"),
            (F.when(~fine & (r.id != ""), 1).otherwise(0) + F.when(is_typed & (verb.isNull() | ~oriented), 1).otherwise(0)).alias("lost"),
            F.when(is_typed & verb.isNotNull() & ~known, r.typelien).alias("unknown_word"),
        )

    def guessed(r: Column) -> Column:
        verb = T.verb_of(r.tag)
        fine = T.is_identifier(r.id)
        empty = F.lit(None)
        return F.struct(
            F.when(fine & verb.isNotNull(), _edge(me, r.id, verb, _props(kind=r.tag, origin=F.lit("heuristic")))).alias("edge"), F.lit(False).alias("configured"),
            empty.cast("struct<target_text:string,relation_type:string,sens:string>").alias("unformatted"), F.when(verb.isNull() | ~fine, 1).otherwise(0).alias("lost"), empty.cast("string").alias("unknown_word"),
        )

    plain = F.transform(F.filter("references", lambda r: ~r.kind.isin(VERSION_KIND, HEURISTIC_KIND)), typed)
    guesses = F.transform(F.filter("references", lambda r: r.kind == HEURISTIC_KIND), guessed)
    bad_versions = F.size(F.filter("references", lambda r: (r.kind == VERSION_KIND) & (r.id != "") & ~T.is_identifier(r.id)))
    above = F.filter("context", lambda a: _isin(a.kind, table.ancestor_tags))
    df = df.withColumn("read", F.concat(plain, guesses)).withColumn("above", above)
    ancestors = F.transform(F.filter("above", lambda a: T.is_identifier(a.id)), lambda a: _edge(a.id, me, F.lit(CONTIENT), _props(kind=a.kind)))
    certain = F.transform(F.filter("read", lambda x: x.edge.isNotNull() & x.configured), lambda x: x.edge)
    loose = F.transform(F.filter("read", lambda x: x.edge.isNotNull() & ~x.configured), lambda x: x.edge)
    lost = F.aggregate("read", F.lit(0), lambda n, x: n + x.lost) + bad_versions + F.size(F.filter("above", lambda a: ~T.is_identifier(a.id)))
    links = F.struct(
        F.concat(version_edges(me, F.col("references")), certain, ancestors).alias("edges"),
        loose.alias("unconfigured"),
        F.transform(F.filter("read", lambda x: x.unformatted.isNotNull()), lambda x: x.unformatted).alias("unformatted"),
        lost.alias("lost"),
        F.array_distinct(F.transform(F.filter("read", lambda x: x.unknown_word.isNotNull()), lambda x: x.unknown_word)).alias("unknown_words"),
    )
    return df.withColumn("links", links).drop("read", "above")


def extract(docs: DataFrame, sources: list[str]) -> DataFrame:
    """with_links() of each source. A row of another source is an error when the query runs."""
    wrong = F.raise_error(F.concat(F.lit("no links for the source "), F.coalesce("source", F.lit("null")))).cast("string")
    docs = docs.withColumn("source", F.when(F.col("source").isin(*sources), F.col("source")).otherwise(wrong))
    return reduce(DataFrame.unionByName, (with_links(docs, s) for s in sources))


def edges(linked: DataFrame, skip_unconfigured: bool = False) -> DataFrame:
    """src, dst, type, props, source, doc, seq: certain edges first, then the unconfigured ones unless they are skipped."""
    held = F.col("links.edges") if skip_unconfigured else F.concat("links.edges", "links.unconfigured")
    return linked.select("source", F.col("identifier").alias("doc"), F.posexplode(held).alias("seq", "e")).select("e.src", "e.dst", "e.type", "e.props", "source", "doc", "seq")


def unformatted(linked: DataFrame) -> DataFrame:
    return linked.select(F.col("identifier").alias("source_identifier"), "source", F.explode("links.unformatted").alias("u")).select("source_identifier", "source", "u.*")
