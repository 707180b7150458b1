"""Scan, parse, link and chunk on small XML files of our own."""

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import chunking, links, parsing
from corpusloom.sources import tables, xml

ONE, TWO, THREE, TEXT = (f"LEGIARTI{n:012d}" for n in (1, 2, 3)), None, None, "LEGITEXT000000000009"
A, B, C = "LEGIARTI000000000001", "LEGIARTI000000000002", "LEGIARTI000000000003"

ARTICLE = f"""<ARTICLE><META><META_COMMUN><ID>{A}</ID><URL>u</URL><NATURE>Article</NATURE></META_COMMUN>
<META_SPEC><META_ARTICLE><NUM>7</NUM><ETAT>VIGUEUR</ETAT><DATE_DEBUT>2001-01-01</DATE_DEBUT></META_ARTICLE></META_SPEC></META>
<CONTEXTE><TEXTE><TITRE_TXT id_txt="{TEXT}">Le code</TITRE_TXT></TEXTE></CONTEXTE>
<VERSIONS><VERSION etat="x"><LIEN_ART id="{B}" debut="1999-01-01" fin="2001-01-01" etat="MODIFIE"/></VERSION>
<VERSION><LIEN_ART id="{A}" debut="2001-01-01" fin="2999-01-01" etat="VIGUEUR"/></VERSION>
<VERSION><LIEN_ART id="{C}" debut="2002-01-01" fin="2002-01-01" etat="MODIFIE_MORT_NE"/></VERSION></VERSIONS>
<BLOC_TEXTUEL><CONTENU><p>Premier&#160; alin&#233;a</p><p>Second <b>omis</b>suite</p></CONTENU></BLOC_TEXTUEL>
<XPTO ref="{C}" mode="m">valeur</XPTO>
<LIENS><LIEN id="{B}" typelien="CITATION" sens="source">cit&#233;</LIEN><LIEN id="{B}" typelien="MODIFICATION" sens="cible">mod</LIEN>
<LIEN id="{B}" typelien="NOUVEAU" sens="source">n</LIEN><LIEN id="{B}" typelien="CITATION" sens="ailleurs">perdu</LIEN>
<LIEN id="" typelien="CREE" sens="source">La loi de demain</LIEN><LIEN id="malforme" typelien="CREE" sens="source">Autre loi</LIEN></LIENS></ARTICLE>"""


def docs(spark, files, source="legi"):
    frame = spark.createDataFrame([(p, bytearray(c.encode())) for p, c in files.items()], "path string, content binary")
    facets = xml.decode_facets(frame, source)
    return facets, parsing.parse(xml.raw_documents(facets), source)


def test_article(spark):
    _, parsed = docs(spark, {"legi/a.xml": ARTICLE})
    row = parsed.first()
    assert (row.identifier, row.document_type, row.nature, row.title, row.reject) == (A, "article", None, "7", None)
    assert row.content == "Premier alinéa\n\nSecond suite"
    assert [s.path for s in row.sections] == [["ARTICLE", "BLOC_TEXTUEL"]]
    assert row.metadata["num"].vals == ["7"] and row.metadata["statut"].vals == ["VIGUEUR"] and not row.metadata["num"].is_list
    assert row.metadata["article_xpto"].vals == ["valeur"] and row.metadata["article_xpto_mode"].vals == ["m"]
    assert {"article_xpto", "article_xpto_mode"} <= set(row.unconfigured_tags)
    assert set(row.unconfigured_links) == {"article_xpto_ref"}
    assert [(c.kind, c.id) for c in row.context] == [("TITRE_TXT", TEXT)]


def test_links(spark):
    _, parsed = docs(spark, {"legi/a.xml": ARTICLE})
    linked = links.with_links(parsed, "legi")
    found = {(e.src, e.dst, e.type) for e in links.edges(linked, skip_unconfigured=True).collect()}
    assert found == {(B, A, "suivi_par"), (A, C, "suivi_par"), (A, B, "cite"), (B, A, "modifie"), (TEXT, A, "contient")}
    more = {(e.src, e.dst, e.type) for e in links.edges(linked).collect()} - found
    assert more == {(A, B, "nouveau"), (A, C, "xpto")}
    row = linked.first().links
    assert row.lost == 2 and row.unknown_words == ["NOUVEAU"]
    assert [(u.target_text, u.relation_type) for u in row.unformatted] == [("La loi de demain", "cree"), ("Autre loi", "cree")]


def test_facets_merge_in_root_order(spark):
    struct = f"<TEXTELR><META><META_COMMUN><ID>{TEXT}</ID></META_COMMUN></META><STRUCT><LIEN_SECTION_TA id='LEGISCTA000000000004'/></STRUCT></TEXTELR>"
    version = f"<TEXTE_VERSION><META><META_COMMUN><ID>{TEXT}</ID><NATURE>Loi</NATURE></META_COMMUN><META_SPEC><META_TEXTE_VERSION><TITRE>Grande loi</TITRE></META_TEXTE_VERSION></META_SPEC></META><VISAS>Vu le code</VISAS></TEXTE_VERSION>"
    _, parsed = docs(spark, {"legi/a/struct.xml": struct, "legi/b/version.xml": version})
    row = parsed.collect()
    assert len(row) == 1 and row[0].title == "Grande loi" and row[0].nature == "LOI" and row[0].content == "Vu le code"
    assert row[0].source_files == ["legi/b/version.xml", "legi/a/struct.xml"]
    assert [(r.kind, r.id) for r in row[0].references] == [("LIEN_SECTION_TA", "LEGISCTA000000000004")]


@pytest.mark.parametrize(
    ("files", "reason"),
    [
        ({"a.xml": "<ARTICLE><ID>nope</ID></ARTICLE>"}, "validation_error"),
        ({"a.xml": "<ARTICLE/>"}, "validation_error"),
        ({"a.xml": "<ARTICLE><ID>ABCDEFGH000000000001</ID></ARTICLE>"}, "validation_error"),
        ({"a.xml": f"<ARTICLE><ID>{A}</ID></ARTICLE>", "b.xml": f"<ARTICLE><ID>{A}</ID></ARTICLE>"}, "validation_error"),
        ({"a.xml": f"<ARTICLE><META><ID>{A}</ID><NUM>1</NUM><NUM>2</NUM></META></ARTICLE>"}, "collision"),
    ],
)
def test_refused(spark, files, reason):
    _, parsed = docs(spark, files)
    assert [r.reject for r in parsed.collect()] == [reason]
    assert parsing.accepted(parsed).count() == 0


def test_skipped_files(spark):
    facets, _ = docs(spark, {"x/versions.xml": "<VERSIONS/>", "bad.xml": "<ARTICLE><ID>", "x/id.xml": "<ID>LEGIARTI000000000001</ID>"})
    assert {r.skip: r["count"] for r in xml.skipped(facets).collect()} == {"export_artifact": 1, "unreadable": 1}


def test_unrenamed_values_become_a_list_and_empty_input(spark):
    body = f"<TEXTE_JURI_JUDI><META><ID>JURITEXT000000000001</ID><NUMERO_AFFAIRE>a</NUMERO_AFFAIRE><NUMERO_AFFAIRE>b</NUMERO_AFFAIRE><DEMANDEUR>x</DEMANDEUR></META></TEXTE_JURI_JUDI>"
    _, parsed = docs(spark, {"j.xml": body}, "cass")
    row = parsed.first()
    assert row.document_type == "decision" and row.metadata["numero_affaire"].vals == ["a", "b"] and row.reject is None
    assert [c.key for c in row.collisions] == ["numero_affaire"]
    assert docs(spark, {"j.xml": body}, "cass")[1].where("identifier = 'none'").count() == 0


@pytest.mark.parametrize(("n", "size", "overlap"), [(10, 8, 6), (100, 10, 3), (7, 8, 2), (50, 20, 19), (8, 8, 0), (1, 5, 0)])
def test_windows_cover_and_do_not_nest(spark, n, size, overlap):
    got = [tuple(w) for w in spark.range(1).select(chunking.windows(F.lit(n), chunking.ChunkConfig(size, overlap)).alias("w")).first().w]
    assert got[0][0] == 0 and got[-1][1] == n and all(b - a <= size for a, b in got)
    assert all(x[0] < y[0] and x[1] < y[1] and y[0] == x[1] - overlap for x, y in zip(got, got[1:]))
    if (n, size, overlap) == (10, 8, 6):
        assert got == [(0, 8), (2, 10)]


def test_blocks_never_move_back(spark):
    rows = spark.sql("SELECT 'ab\\n\\nab\\n\\ncd' AS content, array(named_struct('path', array('x'), 'text', 'ab'), named_struct('path', array('x'), 'text', 'ab'), named_struct('path', array('x'), 'text', 'zz'), named_struct('path', array('x'), 'text', 'cd')) AS sections")
    got = rows.select(chunking.blocks(F.col("content"), F.col("sections")).alias("b")).first().b
    assert [(b.text, b["at"]) for b in got] == [("ab", 0), ("ab", 4), ("cd", 8)]


def test_sources():
    assert tables.resolve_sources(None) == list(tables.TABLES) and tables.resolve_sources("LEGI, cass,legi") == ["legi", "cass"]
    with pytest.raises(ValueError):
        tables.resolve_sources("nowhere")
    with pytest.raises(ValueError):
        tables.table_of("jorf")
    with pytest.raises(ValueError):
        chunking.ChunkConfig(10, 10)
