"""Extraction from already fetched pages ``(page_id, url, html)``.

Flat markup is read with regular expressions inside the JVM. Label boxes, whose value cell may hold a nested table,
go through ``mapInPandas`` with the standard library parser; every page is handled on its own.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions.arrays import spread
from linkloom.functions.equations import align_equation, fix_html_sign, parse_equation, standardize_equation
from linkloom.functions.text import is_available, squeeze, strip_prefix, strip_tags
from linkloom.session import cut, ship_package

LABEL_TAGS = {"nobr", "th", "h2", "h4", "dt", "td"}
VOID = {"br", "img", "hr", "input", "meta", "link", "wbr", "col"}

# Failure notices, some only on pages of one host.
FAILURES = [
    "400 Bad Request",
    "The requested URL is malformed.",
    "404 - File or directory not found.",
    "Invalid URL parameters",
    "Failed to retrieve sequence",
    "File not found",
    "PUGREST.NotFound",
]
HOST_FAILURES = [
    ("ncbi", "Error Blocked Diagnostic"),
    ("kegg.jp", "No such data was found."),
    ("genome.jp", "No such data was found."),
    ("hmdb", "<title>We're sorry, but something went wrong (500)</title>"),
]
MIRRORS = ("kegg.jp", "genome.jp")

# Parts of outbound links and the id type of what follows; the first one that occurs wins.
LINK_PATTERNS = [
    ("www.chemspider.com/Chemical-Structure.", "chemspider"),
    ("chebiID=CHEBI:", "chebi"),
    ("genome.jp/dbget-bin/www_bget?cpd:", "kegg"),
    ("genome.jp/dbget-bin/www_bget?dr:", "kegg"),
    ("www.hmdb.ca/metabolites/", "hmdb"),
    ("biocyc.org/compound?orgid=META&id=", "metacyc"),
    ("drugbank.ca/drugs/", "drugbank"),
    ("ebi.ac.uk/chembl/compound_report_card/", "chembl"),
    ("inchikey=", "inchi_key"),
    ("InChI%3D", "inchi"),
    ("InChI=", "inchi"),
]

# Labels of page boxes and the id type they fill, per kind of page.
KEGG_GENE_DBS = [
    ("ncbi-geneid", "ncbi_genbank_gene"),
    ("ncbi-proteinid", "ncbi_genbank_protein"),
    ("hgnc", "hgnc"),
    ("ensembl", "ensembl"),
    ("uniprot", "uniprot"),
]
KEGG_COMPOUND_DBS = {
    "CAS": "cas",
    "PubChem": "pubchem_sid",
    "KNApSAcK": "knapsack",
    "HMDB": "hmdb",
    "ChEBI": "chebi",
    "ChEMBL": "chembl",
}
HMDB_COMPOUND = {
    "Biospecimen Locations": "location",
    "SMILES": "smiles",
    "InChI Key": "inchi_key",
    "InChI Identifier": "inchi",
    "Common Name": "synonyms",
    "Chemical Formula": "chemical_formula",
    "CAS Registry Number": "cas",
    "DrugBank ID": "drugbank",
    "Phenol Explorer Compound ID": "phenol_explorer",
    "FoodDB ID": "food_db",
    "KNApSAcK ID": "knapsack",
    "Chemspider ID": "chemspider",
    "KEGG Compound ID": "kegg",
    "BioCyc ID": "metacyc",
    "BiGG ID": "bigg",
    "METLIN ID": "metlin",
    "PubChem Compound": "pubchem_cid",
    "PDB ID": "pdb",
    "ChEBI ID": "chebi",
}
HMDB_PROTEIN = {
    "Name": "synonyms",
    "UniProtKB/Swiss-Prot ID": "uniprot",
    "UniProtKB/Swiss-Prot Entry Name": "uniprot_name",
    "PDB IDs": "pdb",
}
HMDB_GENE = {
    "Gene Name": "synonyms",
    "UniProtKB/Swiss-Prot ID": "uniprot",
    "UniProtKB/Swiss-Prot Entry Name": "uniprot_name",
    "GenBank Gene ID": "ncbi_genbank_gene",
    "GenBank Protein ID": "ncbi_genbank_protein",
    "GeneCard ID": "genecard",
    "GenAtlas ID": "genatlas",
    "HGNC ID": "hgnc",
}


# text and the plain tag after it: attributes without a value or with a quoted one
_PLAIN = re.compile(r"""([^<]*)<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:[ \t\n\r\f]+[a-zA-Z][a-zA-Z0-9_-]*(?:=(?:"[^"]*"|'[^']*'))?)*)[ \t\n\r\f]*(/?)>""")
# what these hold is not read as markup by some parser
_RAW = {"script", "style", "textarea", "title", "plaintext", "xmp", "iframe", "noembed", "noframes", "noscript", "svg", "math"}


class _Outline(HTMLParser):
    """Elements of a page in document order, each with the slice of text pieces it spans."""

    def read(self, html: str):
        """Feed a whole page. One of plain tags and text alone is taken apart by one pattern, any other by the parser."""
        if not self._read_plain(html):
            self.pieces, self.elements, self.stack = [], [], []
            self.feed(html)
            self.close()

    def _read_plain(self, html: str) -> bool:
        """Whether the page was plain; if not, what has been read of it is of no use."""
        at = 0
        while m := _PLAIN.match(html, at):
            text, end, tag, attrs, empty = m.groups()
            tag = tag.lower()
            if tag in _RAW or (end and (attrs or empty)):
                return False
            if text:
                self.pieces.append(unescape(text))
            if end:
                self.handle_endtag(tag)
            elif empty:
                self.handle_startendtag(tag, ())
            else:
                self.handle_starttag(tag, ())
            at = m.end()
        rest = html[at:]
        if rest:
            self.pieces.append(unescape(rest))
        return "<" not in rest

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.pieces: list[str] = []
        self.elements: list[list] = []
        self.stack: list[int] = []

    def handle_starttag(self, tag, attrs):
        self.elements.append([tag, len(self.pieces), None])
        if tag in VOID:
            self.elements[-1][2] = len(self.pieces)
        else:
            self.stack.append(len(self.elements) - 1)

    def handle_endtag(self, tag):
        for depth in range(len(self.stack) - 1, -1, -1):
            if self.elements[self.stack[depth]][0] == tag:
                for i in self.stack[depth:]:
                    self.elements[i][2] = len(self.pieces)
                del self.stack[depth:]
                return

    def handle_data(self, data):
        self.pieces.append(data)

    def short_text(self, i: int, longest: int) -> str | None:
        """The text of an element as a label; none if it is far longer than any label."""
        _, a, b = self.elements[i]
        text = ""
        for piece in self.pieces[a:b]:
            text = (text + piece).lstrip()
            if len(text.rstrip()) > 4 * longest:
                return None
        return unicodedata.normalize("NFKD", text).strip().rstrip(":")

    def text(self, i: int) -> str:
        _, a, b = self.elements[i]
        return unicodedata.normalize("NFKD", "".join(self.pieces[a:b]))


def _page_boxes(html: str, labels: set[str]):
    """``(label, pos, value, cells)`` for each label cell: the text of the element after it and of the cells inside.

    ``pos`` counts the boxes of the same label on the page, from 0.
    """
    page = _Outline()
    page.read(html or "")
    for e in page.elements:
        if e[2] is None:
            e[2] = len(page.pieces)
    longest, seen, until = max(map(len, labels), default=0) + 1, Counter(), {}
    for i, (tag, a, b) in enumerate(page.elements[:-1]):
        if tag not in LABEL_TAGS:
            continue
        label = page.short_text(i, longest)
        if label not in labels or a < until.get(label, 0):  # a label cell inside a label cell is the same one
            continue
        nxt = i + 1
        while nxt < len(page.elements) and page.elements[nxt][1] < b:
            nxt += 1  # elements inside the label cell itself
        if nxt == len(page.elements):
            continue
        pos, until[label] = seen[label], b
        seen[label] += 1
        end = page.elements[nxt][2]
        cells = []
        for j in range(nxt + 1, len(page.elements)):
            if page.elements[j][1] >= end:
                break
            if page.elements[j][0] == "td":
                cells.append(page.text(j).strip())
        yield label, pos, page.text(nxt).strip("\n").strip(), cells


def extract_boxes(pages: DataFrame, labels: list[str], keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """``(*keep, label, pos, value, cells)``: every box of each label on a page; ``pos`` counts a label's boxes from 0.

    Parsing is far dearer than moving a page, and tables of many pages may come in very few splits, so pages are dealt over
    all tasks first.
    """
    wanted, names = set(labels), [*keep, "label", "pos", "value", "cells"]
    ship_package(pages.sparkSession)

    def run(batches):
        for pdf in batches:
            rows = [(*row[1:], *box) for row in pdf.itertuples(index=False) for box in _page_boxes(row[0], wanted)]
            yield pd.DataFrame(rows, columns=names)

    kinds = "".join(f"{c} {t}, " for c, t in pages.select(*keep).dtypes)
    tasks = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pages.select("html", *keep).repartition(tasks).mapInPandas(run, f"{kinds}label string, pos int, value string, cells array<string>")


def box_pairs(boxes: DataFrame) -> DataFrame:
    """Cells of a box read two by two: ``(page_id, label, pos, k, v)``."""
    n = F.size("cells")
    pairs = F.transform(
        F.sequence(F.lit(1), F.greatest((n / 2).cast("int"), F.lit(1))),
        lambda i: F.struct((i - 1).alias("pos"), F.try_element_at("cells", 2 * i - 1).alias("k"), F.try_element_at("cells", 2 * i).alias("v")))
    keep = [c for c in boxes.columns if c not in ("value", "cells", "pos")]
    return boxes.filter(n >= 2).select(*keep, F.explode(pairs).alias("p")).select(
        *keep, "p.pos", F.regexp_replace("p.k", ":$", "").alias("k"), F.col("p.v").alias("v"))


def page_key(url="url") -> Column:
    """The id a page was asked for: what follows the last ``:``, ``/``, ``=`` or ``?`` of its url."""
    return F.regexp_extract(url, r"([^:/=?#]+)/?$", 1)


def page_text(pages: DataFrame) -> DataFrame:
    """Readable text of a page: scripts and styles out, markup out, blanks collapsed."""
    bare = F.regexp_replace("html", r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    spaced = F.regexp_replace(bare, r"(?i)<(/p|br|/li|/h1|/title|/div|/tr|/td)[^>]*>", " ")
    return pages.select("page_id", F.trim(F.regexp_replace(strip_tags(spaced), r"\s+", " ")).alias("text"))


def _inner(tag: str) -> Column:
    """What every ``tag`` element of a page holds, markup included."""
    return F.regexp_extract_all("html", F.lit(rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>"), F.lit(1))


def _hrefs() -> Column:
    """Targets of all links of a page."""
    return F.regexp_extract_all("html", F.lit(r'(?i)<a\s[^>]*?href="([^"]*)"'), F.lit(1))


def page_cells(pages: DataFrame, tag: str) -> DataFrame:
    """Text of every ``tag`` element in order: ``(page_id, pos, value)``; a column ``entity_key`` goes along."""
    keep = ["page_id", *[c for c in ("entity_key",) if c in pages.columns]]
    return spread(pages, _inner(tag), "raw", *keep, pos="pos").select(*keep, "pos", squeeze(strip_tags("raw")).alias("value"))


def page_links(pages: DataFrame, pattern: str | None = None) -> DataFrame:
    """Targets of links in order: ``(page_id, pos, href)``; ``pattern`` keeps those that match it."""
    keep = ["page_id", *[c for c in ("entity_key",) if c in pages.columns]]
    out = spread(pages, _hrefs(), "href", *keep, pos="pos")
    return out.filter(F.col("href").rlike(pattern)) if pattern else out


def extract_table(pages: DataFrame) -> DataFrame:
    """Table rows with their cells named by the table head: ``(page_id, row, cells array<struct<k, v>>)``.

    A table spread over several pages just gives more rows; the row is the unit, so nothing is shuffled.
    """
    text = lambda tag, c: F.transform(F.regexp_extract_all(c, F.lit(rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>"), F.lit(1)), lambda x: squeeze(strip_tags(x)))
    rows = F.regexp_extract_all("html", F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    each = spread(pages, rows, "tr", "page_id", text("th", F.col("html")).alias("head"), pos="row")
    named = F.transform(text("td", F.col("tr")), lambda v, i: F.struct(F.try_element_at("head", i + 1).alias("k"), v.alias("v")))
    return each.filter(F.contains(F.lower("tr"), F.lit("<td"))).select("page_id", "row", named.alias("cells"))


def rows_of_type(rows: DataFrame, key: str = "HMDBP ID", kind: str = "Enzyme") -> DataFrame:
    """Rows whose ``Type`` is ``kind``: ``(page_id, id)``."""
    pick = lambda k: F.try_element_at(F.filter("cells", lambda x: x["k"] == k), F.lit(1))["v"]
    return rows.select("page_id", pick("Type").alias("type"), pick(key).alias("id")).filter(
        (F.col("type") == kind) & F.col("id").isNotNull()).select("page_id", "id").distinct()


def classify_links(urls: DataFrame, patterns: list[tuple[str, str]] = LINK_PATTERNS, column: str = "url") -> DataFrame:
    """Outbound links to ``(url, id_type, id_value)``; links without a known part are dropped."""
    kind, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    u = F.col(column)
    for part, id_type in reversed(patterns):
        hit = F.contains(u, F.lit(part))
        after = F.element_at(F.split(u, "\\Q" + part + "\\E", -1), 2)
        kind = F.when(hit, F.lit(id_type)).otherwise(kind)
        value = F.when(hit, after).otherwise(value)
    clean = strip_tags(F.replace(F.replace(value, F.lit(".html"), F.lit("")), F.lit("%0A"), F.lit("")))
    keep = [c for c in urls.columns if c != column]
    return urls.select(*keep, u.alias("url"), kind.alias("id_type"), clean.alias("id_value")).filter(F.col("id_type").isNotNull())


def search_hits(pages: DataFrame, max_hits: int | None = None, cap: int | None = None) -> DataFrame:
    """Candidate ids of search result pages: ``(page_id, pos, id)``.

    Pages without results or with a 'did you mean' notice give nothing. All hits are listed; a caller may leave out
    pages with more than ``max_hits`` hits, and candidates of a page from the ``cap``-th on.
    """
    info = strip_tags(F.regexp_extract("html", r'(?is)class="page_info"[^>]*>(.*?)</div>', 1))
    numbers = F.transform(F.regexp_extract_all(F.concat(info, F.lit(" ")), F.lit(r"(\d+)\s"), F.lit(1)), lambda x: x.cast("int"))
    total = F.when(F.size(numbers) == 3, F.element_at(numbers, 3)).otherwise(F.try_element_at(numbers, F.lit(1)))
    bad = F.contains("html", F.lit("no-results")) | F.contains("html", F.lit('id="didyoumean"'))
    ids = F.array_distinct(F.regexp_extract_all("html", F.lit(r'(?is)<a[^>]*btn-card[^>]*/metabolites/(HMDB\d+)'), F.lit(1)))
    ok = pages.filter(~bad if max_hits is None else ~bad & (total <= max_hits))
    listed = F.slice(ids, 1, cap) if cap else ids
    return spread(ok, listed, "id", "page_id", pos="pos")


def screen_pages(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split pages into usable ones and known failure notices (with the notice)."""
    notice = F.lit(None).cast("string")
    for host, text in reversed(HOST_FAILURES):
        notice = F.when(F.contains("url", F.lit(host)) & F.contains("html", F.lit(text)), F.lit(text)).otherwise(notice)
    for text in reversed(FAILURES):
        notice = F.when(F.contains("html", F.lit(text)), F.lit(text)).otherwise(notice)
    judged = pages.withColumn("notice", notice)
    return judged.filter(F.col("notice").isNull()).drop("notice"), judged.filter(F.col("notice").isNotNull())


def with_mirror(pages: DataFrame, hosts: tuple[str, str] = MIRRORS) -> DataFrame:
    """Usable pages, a missing one taken from the same path at the other host: ``(page_id, url, html, mirrored)``."""
    a, b = hosts
    other = F.when(F.contains("url", F.lit(a)), F.replace("url", F.lit(a), F.lit(b))).otherwise(F.replace("url", F.lit(b), F.lit(a)))
    ok, bad = screen_pages(pages)
    first = ok.groupBy(F.col("url").alias("other")).agg(F.min_by("html", "page_id").alias("alt"))
    saved = bad.select("page_id", "url", other.alias("other")).join(first, "other")
    return ok.select("page_id", "url", "html", F.lit(False).alias("mirrored")).unionByName(
        saved.select("page_id", "url", F.col("alt").alias("html"), F.lit(True).alias("mirrored")))


def _xref(df: DataFrame, entity_type: str, source_db: str) -> DataFrame:
    return df.filter(is_available("id_value")).select(
        F.lit(entity_type).alias("entity_type"), "entity_key", F.lit(source_db).alias("source_db"), "id_type",
        squeeze("id_value").alias("id_value"), F.lit(1).cast("bigint").alias("n")).distinct()


def _edge(df: DataFrame, edge_type: str, source_db: str) -> DataFrame:
    return df.select(F.lit(edge_type).alias("edge_type"), F.col("entity_key").alias("src_key"), F.col("target").alias("dst_key"),
                     F.lit(source_db).alias("source_db")).distinct()


def _keyed(pages: DataFrame, labels: list[str]) -> DataFrame:
    """First boxes with the key of their page. Written once: every field of a page is read from it, the page is parsed once."""
    keyed = pages.withColumn("entity_key", page_key())
    return cut(extract_boxes(keyed, labels, ("page_id", "entity_key")).filter("pos = 0").drop("pos"))


def _named(b: DataFrame, label: str, id_type: str, sep: str, lower: bool = False) -> DataFrame:
    v = F.lower("value") if lower else F.col("value")
    return b.filter(F.col("label") == label).select("entity_key", F.lit(id_type).alias("id_type"), F.explode(F.split(v, sep)).alias("id_value"))


def _own(pages: DataFrame, id_type: str) -> DataFrame:
    return pages.select(page_key().alias("entity_key"), F.lit(id_type).alias("id_type"), page_key().alias("id_value"))


def _tagged(b: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """One value per box, by label."""
    kind = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return b.filter(F.col("label").isin(list(mapping))).select("entity_key", F.element_at(kind, F.col("label")).alias("id_type"), F.col("value").alias("id_value"))


def _pairs(b: DataFrame, label: str) -> DataFrame:
    return box_pairs(b.filter(F.col("label") == label))


def kegg_gene(pages: DataFrame) -> dict[str, DataFrame]:
    """Gene pages: names, orthology group, linked enzyme numbers, ids of other databases."""
    b = _keyed(pages, ["Gene name", "KO", "Other DBs"])
    ko = b.filter(F.col("label") == "KO")
    group = ko.select("entity_key", F.lit("kegg_ko").alias("id_type"), F.element_at(F.split(F.trim("value"), r"\s+"), 1).alias("id_value"))
    ecs = ko.select("entity_key", F.explode(F.split(F.regexp_extract("value", r"\[EC:([^\]]*)\]", 1), r"\s+")).alias("target")).filter(
        F.col("target").rlike(r"^(\d+\.){2,3}\d+$"))
    other = _pairs(b, "Other DBs")
    kind = F.lit(None).cast("string")
    for part, id_type in KEGG_GENE_DBS:
        kind = F.when(F.contains(F.lower("k"), F.lit(part)), F.lit(id_type)).otherwise(kind)
    ids = other.select("entity_key", kind.alias("id_type"), F.explode(F.split("v", r"\s+")).alias("id_value")).filter(F.col("id_type").isNotNull())
    rows = _own(pages, "kegg").unionByName(_named(b, "Gene name", "synonyms", ",")).unionByName(group).unionByName(ids)
    return {"xref": _xref(rows, "gene", "kegg"), "edge": _edge(ecs, "gp", "kegg")}


def kegg_enzyme(pages: DataFrame) -> dict[str, DataFrame]:
    """Enzyme pages: names, orthology groups, CAS, BRENDA; genes as ``org:id``; reactions."""
    b = _keyed(pages, ["Name", "Orthology", "CAS", "BRENDA, the Enzyme Database", "Genes", "Reaction(KEGG)"])
    kos = _pairs(b, "Orthology").select("entity_key", F.lit("kegg_ko").alias("id_type"), F.col("k").alias("id_value"))
    ext = _named(b, "CAS", "cas", r"\s+").unionByName(_named(b, "BRENDA, the Enzyme Database", "brenda", r"\s+"))
    genes = _pairs(b, "Genes").select("entity_key", F.lower("k").alias("org"), F.explode(F.split("v", r"\s+")).alias("g")).filter(F.col("g") != "").select(
        "entity_key", F.concat_ws(":", "org", F.substring_index("g", "(", 1)).alias("target"))
    reactions = b.filter(F.col("label") == "Reaction(KEGG)").select(
        "entity_key", F.explode(F.regexp_extract_all("value", F.lit(r"(R\d+)"), F.lit(1))).alias("target"))
    rows = _own(pages, "kegg").unionByName(_named(b, "Name", "synonyms", ";", True)).unionByName(kos).unionByName(ext)
    return {"xref": _xref(rows, "protein", "kegg"), "edge": _edge(genes, "pg", "kegg").unionByName(_edge(reactions, "pr", "kegg"))}


def equation_compound(name: Column) -> Column:
    """Compound id of an equation term: the first ``[A-Z]+digits``, else the text before ``(``."""
    hit = F.regexp_extract(name, r"([A-Z]+\d+)", 1)
    return F.when(hit != "", hit).otherwise(F.substring_index(name, "(", 1))


def kegg_reaction(pages: DataFrame) -> dict[str, DataFrame]:
    """Reaction pages: definition, id equation, pathways, enzyme numbers, orthology groups, Rhea ids."""
    b = _keyed(pages, ["Definition", "Equation", "Pathway", "Enzyme", "Orthology", "Other DBs"])
    pick = lambda label: F.max(F.when(F.col("label") == label, F.col("value")))
    eq = b.groupBy("entity_key").agg(pick("Definition").alias("definition"), pick("Equation").alias("ids"))
    parts = align_equation(F.coalesce("definition", "ids"), F.coalesce("ids", "definition"))
    p = spread(eq, parts, "p", "entity_key").select(
        F.col("entity_key").alias("reaction_key"), "p.side", "p.pos", "p.stoich", "p.stoich_raw", equation_compound(F.col("p.name")).alias("compound_key"))
    text = eq.filter(F.col("definition").isNotNull()).select("entity_key", F.lit("reaction_str").alias("id_type"), standardize_equation("definition").alias("id_value"))
    paths = _pairs(b, "Pathway").select("entity_key", F.lit("pathways").alias("id_type"), F.concat_ws(" : ", "k", "v").alias("id_value"))
    kos = _pairs(b, "Orthology").select("entity_key", F.lit("kegg_ko").alias("id_type"), F.col("k").alias("id_value"))
    rhea = _pairs(b, "Other DBs").filter(F.col("k") == "RHEA").select("entity_key", F.lit("rhea").alias("id_type"), F.col("v").alias("id_value"))
    ecs = b.filter(F.col("label") == "Enzyme").select("entity_key", F.explode(F.split(F.trim("value"), r"\s+")).alias("target")).filter(
        ~F.col("target").endswith("-") & (F.col("target") != ""))
    rows = _own(pages, "kegg").unionByName(text).unionByName(paths).unionByName(kos).unionByName(rhea)
    return {"xref": _xref(rows, "reaction", "kegg"), "participant": p, "edge": _edge(ecs, "rp", "kegg")}


def kegg_compound(pages: DataFrame) -> dict[str, DataFrame]:
    """Compound pages: names, formula, ids of six databases, reactions."""
    b = _keyed(pages, ["Name", "Formula", "Other DBs", "Reaction"])
    kind = F.try_element_at(F.create_map(*[F.lit(x) for kv in KEGG_COMPOUND_DBS.items() for x in kv]), F.trim(F.col("k")))
    ids = _pairs(b, "Other DBs").select("entity_key", kind.alias("id_type"), F.explode(F.split(F.trim("v"), r"\s+")).alias("id_value")).filter(
        F.col("id_type").isNotNull())
    reactions = b.filter(F.col("label") == "Reaction").select("entity_key", F.explode(F.split(F.trim("value"), r"\s+")).alias("target")).filter(F.col("target") != "")
    rows = (
        _own(pages, "kegg").unionByName(_named(b, "Name", "synonyms", ";", True))
        .unionByName(_tagged(b, {"Formula": "chemical_formula"})).unionByName(ids)
    )
    return {"xref": _xref(rows, "compound", "kegg"), "edge": _edge(reactions, "cr", "kegg")}


def hmdb_compound(pages: DataFrame) -> dict[str, DataFrame]:
    """Metabolite pages: names, structure, formula, ids of other databases, linked enzymes."""
    b = _keyed(pages, list(HMDB_COMPOUND))
    v = _tagged(b, HMDB_COMPOUND)
    value = (
        F.when(F.col("id_type").isin("inchi", "inchi_key"), strip_prefix("id_value"))
        .when(F.col("id_type") == "synonyms", F.lower("id_value")).otherwise(F.col("id_value"))
    )
    v = v.select("entity_key", "id_type", F.explode(F.when(F.col("id_type") == "location", F.split("id_value", "\n")).otherwise(F.array(value))).alias("id_value"))
    enzymes = page_links(pages.withColumn("entity_key", page_key()), r"^/proteins/HMDBP\d+").select(
        "entity_key", F.regexp_extract("href", r"(HMDBP\d+)", 1).alias("target"))
    return {"xref": _xref(_own(pages, "hmdb").unionByName(v), "compound", "hmdb"), "edge": _edge(enzymes, "cp", "hmdb")}


def hmdb_protein(pages: DataFrame) -> dict[str, DataFrame]:
    """Protein pages serve proteins and their genes; reactions are linked by path."""
    labels = sorted({*HMDB_PROTEIN, *HMDB_GENE})
    b = _keyed(pages, labels)
    clean = F.regexp_replace("id_value", r'["\[\]]', "")
    many = lambda m: _tagged(b, m).select("entity_key", "id_type", F.explode(
        F.when(F.col("id_type") == "synonyms", F.array("id_value")).otherwise(F.split(clean, r"[,\n]"))).alias("id_value")).filter(squeeze("id_value") != "")
    keys = pages.withColumn("entity_key", page_key())
    reactions = page_links(keys, r"/reactions/\d+").select("entity_key", F.regexp_extract("href", r"/reactions/(\d+)", 1).alias("target"))
    protein = _xref(_own(pages, "hmdb").unionByName(many(HMDB_PROTEIN)), "protein", "hmdb")
    gene = _xref(_own(pages, "hmdb").unionByName(many(HMDB_GENE)), "gene", "hmdb")
    both = keys.select("entity_key", F.col("entity_key").alias("target"))
    return {
        "xref": protein.unionByName(gene),
        "edge": _edge(reactions, "pr", "hmdb").unionByName(_edge(both, "pg", "hmdb")).unionByName(_edge(both, "gp", "hmdb")),
    }


def hmdb_reaction(pages: DataFrame) -> dict[str, DataFrame]:
    """Reaction pages: equation text, participants by linked name, external id, linked proteins.

    What the patterns find on a page is written once, and every field is read from that: a page is made and scanned once.
    """
    panel = F.regexp_extract("html", r'(?is)class="[^"]*panel-heading[^"]*"[^>]*>.*?<strong[^>]*>(.*?)</strong>', 1)
    raw = strip_tags(F.regexp_replace("panel", r"[\n\t]", ""))
    text = fix_html_sign(F.replace(F.replace(raw, F.lit("+"), F.lit(" + ")), F.lit("="), F.lit(" = ")))
    found = pages.select(page_key().alias("entity_key"), panel.alias("panel"), _inner("li").alias("li"), _hrefs().alias("hrefs"))
    b = cut(found.select("entity_key", "panel", standardize_equation(text).alias("equation"), "li", "hrefs"))
    eq = b.filter(F.col("panel") != "")
    anchors = F.regexp_extract_all("panel", F.lit(r'(?is)(<a\s[^>]*/metabolites/[^>]*>.*?</a>)'), F.lit(1))
    names = spread(eq, anchors, "a", "entity_key").select(
        "entity_key", F.lower(squeeze(strip_tags("a"))).alias("lname"), F.regexp_extract("a", r'/metabolites/([^"/?#]+)', 1).alias("id")
    ).groupBy("entity_key", "lname").agg(F.min("id").alias("source_id"))
    parts = spread(eq, parse_equation("equation"), "p", "entity_key").select("entity_key", "p.*").withColumn("lname", F.lower("name"))
    p = parts.join(names, ["entity_key", "lname"], "left").select(
        F.col("entity_key").alias("reaction_key"), "side", "pos", "stoich", "stoich_raw", "name", F.lit("hmdb").alias("source_db"), "source_id")
    cells = spread(b, "li", "raw", "entity_key").select("entity_key", squeeze(strip_tags("raw")).alias("value"))
    ext = cells.filter(F.contains(F.lower("value"), F.lit("kegg")) & F.contains("value", F.lit(":"))).select(
        "entity_key", F.lit("kegg").alias("id_type"), F.trim(F.element_at(F.split("value", ":"), 2)).alias("id_value"))
    strs = eq.select("entity_key", F.lit("reaction_str").alias("id_type"), F.col("equation").alias("id_value"))
    proteins = spread(b, "hrefs", "href", "entity_key").filter(F.col("href").rlike(r"^/proteins/HMDBP\d+")).select(
        "entity_key", F.regexp_extract("href", r"(HMDBP\d+)", 1).alias("target"))
    own = b.select("entity_key", F.lit("hmdb").alias("id_type"), F.col("entity_key").alias("id_value"))
    return {"xref": _xref(own.unionByName(strs).unionByName(ext), "reaction", "hmdb"), "participant": p, "edge": _edge(proteins, "rp", "hmdb")}


KINDS = {
    "kegg_gene": kegg_gene,
    "kegg_enzyme": kegg_enzyme,
    "kegg_reaction": kegg_reaction,
    "kegg_compound": kegg_compound,
    "hmdb_compound": hmdb_compound,
    "hmdb_protein": hmdb_protein,
    "hmdb_reaction": hmdb_reaction,
}


def pages_to_xref(pages: DataFrame, kind: str) -> dict[str, DataFrame]:
    """Frames ``xref``, ``edge`` and, for reactions, ``participant`` of one kind of page."""
    return KINDS[kind](pages)
