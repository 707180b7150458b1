"""Role tables: how each source's XML is to be read. Data only, one table for each family of roots."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

META, VERSION, TITLE, BODY, LINK, IGNORED = "META", "VERSION", "TITLE", "BODY", "LINK", "IGNORED"


@dataclass(frozen=True)
class RoleTable:
    """roots in merge order; roles by tag; prefixes: first eight letters of an identifier -> document type."""

    roots: tuple[str, ...]
    roles: Mapping[str, str]
    prefixes: Mapping[str, str]
    renames: Mapping[str, str]
    transparent: Mapping[str, str]
    content_blocks: tuple[str, ...] = ("BLOC_TEXTUEL",)
    text_holders: tuple[str, ...] = ("CONTENU",)
    title_tags: tuple[str, ...] = ("TITRE",)
    uninformative_natures: frozenset[str] = frozenset()
    list_keys: frozenset[str] = frozenset()
    verbs: Mapping[str, str] = field(default_factory=dict)
    link_tags: tuple[str, ...] = ("LIEN",)
    structural_containers: tuple[str, ...] = ()
    structural_tags: tuple[str, ...] = ()
    version_containers: tuple[str, ...] = ()
    version_tags: tuple[str, ...] = ()
    ancestor_containers: tuple[str, ...] = ()
    ancestor_tags: tuple[str, ...] = ()
    ancestor_ids: tuple[str, ...] = ("id_txt", "id")
    identifier_tag: str = "ID"
    nature_tag: str = "NATURE"
    meta_container: str = "META"

    @property
    def known(self) -> set[str]:
        return {*self.roots, *self.roles, *self.transparent}

    @property
    def collectable(self) -> set[str]:
        """Tags whose leaves under the meta container are metadata."""
        return {t for t, role in self.roles.items() if role in (META, VERSION)} - {self.identifier_tag, self.nature_tag}


def _roles(**by_role: tuple[str, ...]) -> dict[str, str]:
    """Tag -> role."""
    return {tag: role for role, tags in by_role.items() for tag in tags}


# Fixed values, which must equal those of the data: tags and their roles, names, separators, verbs.

LEGI = RoleTable(
    roots=("TEXTE_VERSION", "TEXTELR", "ARTICLE", "SECTION_TA"),
    roles=_roles(
        BODY=("BLOC_TEXTUEL", "CONTENU", "VISAS", "SIGNATAIRES", "TP", "TEXTE", "NOTA"),
        LINK=("LIENS", "LIEN", "LIEN_ART", "LIEN_SECTION_TA", "LIEN_TXT", "CONTEXTE", "TITRE_TXT", "TITRE_TM", "TM", "STRUCT", "STRUCTURE_TA"),
        VERSION=("DATE_DEBUT", "DATE_FIN", "ETAT", "VERSION", "VERSIONS", "VERSION_A_VENIR", "VERSIONS_A_VENIR", "ABRO", "RECT"),
        META=("TEXTE_VERSION", "TEXTELR", "ARTICLE", "SECTION_TA", "META", "META_ARTICLE", "META_COMMUN", "META_SPEC", "META_TEXTE_CHRONICLE", "META_TEXTE_VERSION", "ID", "NUM", "ANCIEN_ID", "AUTORITE", "CID", "DATE_PUBLI", "DATE_TEXTE", "DERNIERE_MODIFICATION", "MINISTERE", "NATURE", "NOR", "NUM_PARUTION", "NUM_SEQUENCE", "ORIGINE", "ORIGINE_PUBLI", "PAGE_DEB_PUBLI", "PAGE_FIN_PUBLI", "TITREFULL", "TYPE"),
        TITLE=("TITRE", "TITRE_TA"),
        IGNORED=("URL",),
    ),
    prefixes={"LEGIARTI": "article", "LEGITEXT": "texte", "LEGISCTA": "section"},
    renames={
        "ANCIEN_ID": "ancien_id",
        "CID": "chronicle_cid",
        "DATE_DEBUT": "date_debut",
        "DATE_FIN": "date_fin",
        "DATE_PUBLI": "date_publication",
        "DATE_TEXTE": "date_texte",
        "DERNIERE_MODIFICATION": "derniere_modification",
        "ETAT": "statut",
        "NOR": "nor",
        "NUM": "num",
        "NUM_PARUTION": "num_parution",
        "NUM_SEQUENCE": "num_sequence",
        "ORIGINE": "origine",
        "ORIGINE_PUBLI": "origine_publication",
        "PAGE_DEB_PUBLI": "page_debut_publication",
        "PAGE_FIN_PUBLI": "page_fin_publication",
        "TITREFULL": "titre_full",
        "TYPE": "type",
        "VERSION_A_VENIR": "versions_a_venir",
    },
    transparent={"p": "\n\n", "br": "\n", "blockquote": "\n\n", "div": "\n", "em": "", "font": "", "span": "", "sup": "", "table": "\n", "tbody": "", "thead": "", "tr": "\n", "td": " ", "th": " "},
    content_blocks=("BLOC_TEXTUEL", "VISAS", "SIGNATAIRES", "TP"),
    title_tags=("TITRE", "TITRE_TA", "NUM"),
    uninformative_natures=frozenset({"ARTICLE"}),
    list_keys=frozenset({"versions_a_venir"}),
    verbs={
        "CITATION": "cite",
        "MODIFIE": "modifie",
        "MODIFICATION": "modifie",
        "ABROGE": "abroge",
        "ABROGATION": "abroge",
        "CREE": "cree",
        "CREATION": "cree",
        "TXT_SOURCE": "source",
        "CODIFICATION": "codifie",
        "CONCORDANCE": "concorde",
        "CONCORDE": "concorde",
        "SPEC_APPLI": "applique_spec",
        "APPLICATION": "applique",
        "TXT_ASSOCIE": "associe",
        "TRANSFERT": "transfere",
        "DEPLACE": "deplace",
    },
    structural_containers=("STRUCTURE_TA", "STRUCT"),
    structural_tags=("LIEN_ART", "LIEN_SECTION_TA"),
    version_containers=("VERSIONS",),
    version_tags=("LIEN_ART",),
    ancestor_containers=("CONTEXTE",),
    ancestor_tags=("TITRE_TXT", "TITRE_TM"),
)

_JURI_ROLES = _roles(
    META=("META", "META_COMMUN", "META_SPEC", "META_JURI", "ID", "ANCIEN_ID", "ORIGINE", "NATURE", "ECLI", "DATE_DEC", "JURIDICTION", "NUMERO", "SOLUTION"),
    BODY=("TEXTE", "BLOC_TEXTUEL", "CONTENU"),
    TITLE=("TITRE",),
    LINK=("LIENS", "LIEN"),
    IGNORED=("URL",),
)
_JURI_RENAMES = {
    "ANCIEN_ID": "ancien_id",
    "ORIGINE": "origine",
    "DATE_DEC": "date_decision",
    "JURIDICTION": "juridiction",
    "NUMERO": "numero",
    "SOLUTION": "solution",
    "ECLI": "ecli",
}


def _juri(root: str, prefix: str, roles: dict[str, str], renames: dict[str, str], **more) -> RoleTable:
    return RoleTable(roots=(root,), roles={root: META} | _JURI_ROLES | roles, prefixes={prefix: "decision"}, renames=_JURI_RENAMES | renames, transparent={"p": "\n\n", "br": "\n"}, verbs={"CITATION": "cite"}, **more)


JUDICIAL = _juri(
    "TEXTE_JURI_JUDI",
    "JURITEXT",
    _roles(
        META=("META_JURI_JUDI", "FORMATION", "FORM_DEC_ATT", "DATE_DEC_ATT", "SIEGE_APPEL", "JURI_PREM", "LIEU_PREM", "DEMANDEUR", "DEFENDEUR", "PRESIDENT", "AVOCAT_GL", "AVOCATS", "RAPPORTEUR", "NUMEROS_AFFAIRES", "NUMERO_AFFAIRE", "PUBLI_BULL"),
        BODY=("SOMMAIRE", "SCT", "ANA", "CITATION_JP"),
    ),
    {
        "FORMATION": "formation",
        "PRESIDENT": "president",
        "AVOCATS": "avocats",
        "RAPPORTEUR": "rapporteur",
        "NUMERO_AFFAIRE": "numero_affaire",
        "DATE_DEC_ATT": "date_decision_attaquee",
        "FORM_DEC_ATT": "formation_decision_attaquee",
        "SIEGE_APPEL": "siege_appel",
    },
    list_keys=frozenset({"numero_affaire"}),
)

ADMINISTRATIVE = _juri(
    "TEXTE_JURI_ADMIN",
    "CETATEXT",
    _roles(
        META=("META_JURI_ADMIN", "FORMATION", "TYPE_REC", "PUBLI_RECUEIL", "DEMANDEUR", "DEFENDEUR", "PRESIDENT", "AVOCATS", "RAPPORTEUR", "COMMISSAIRE_GVT"),
        BODY=("SOMMAIRE", "SCT", "ANA", "CITATION_JP"),
    ),
    {
        "FORMATION": "formation",
        "PRESIDENT": "president",
        "AVOCATS": "avocats",
        "RAPPORTEUR": "rapporteur",
        "TYPE_REC": "type_recours",
        "PUBLI_RECUEIL": "publication_recueil",
        "COMMISSAIRE_GVT": "rapporteur_public",
    },
    uninformative_natures=frozenset({"TEXTE"}),
)

CONSTITUTIONAL = _juri(
    "TEXTE_JURI_CONSTIT",
    "CONSTEXT",
    _roles(META=("META_JURI_CONSTIT", "NOR", "NATURE_QUALIFIEE", "TITRE_JO", "URL_CC", "LOI_DEF"), BODY=("SAISINES", "OBSERVATIONS")),
    {"NOR": "nor", "NATURE_QUALIFIEE": "nature_qualifiee", "TITRE_JO": "titre_jo", "URL_CC": "url_conseil_constitutionnel"},
)

#: Source -> table, in the order in which all sources are read. Each lies in a folder of its name.
TABLES = {"legi": LEGI, "capp": JUDICIAL, "cass": JUDICIAL, "inca": JUDICIAL, "jade": ADMINISTRATIVE, "constit": CONSTITUTIONAL}
#: Names without a connector: accepted as a parameter, refused when a scan is asked for.
UNCONNECTED = ("jorf", "upload")
#: Sources of which several files are facets of one document.
FACETED = frozenset({"legi"})


def resolve_sources(value: str | None) -> list[str]:
    """None, '', 'all' and '*' are all sources; else a comma list, in order, without repeats and regardless of case."""
    if value is None or value.strip().lower() in ("", "all", "*"):
        return list(TABLES)
    names = list(dict.fromkeys(x.strip().lower() for x in value.split(",") if x.strip()))
    if unknown := [n for n in names if n not in TABLES and n not in UNCONNECTED]:
        raise ValueError(f"unknown sources: {', '.join(unknown)}")
    return names


def table_of(source: str) -> RoleTable:
    if source not in TABLES:
        raise ValueError(f"no connector for the source {source!r}")
    return TABLES[source]
