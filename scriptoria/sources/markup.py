"""TEI markup to rows. One document per input row, so files are parsed in parallel and none meets the driver."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from xml.etree import ElementInclude
from xml.etree import ElementTree as ET
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_TEI, _XML = "{http://www.tei-c.org/ns/1.0}", "{http://www.w3.org/XML/1998/namespace}"


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, content) of each XML file."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.xml").option("recursiveFileLookup", True).load(path)
    return raw.select("path", F.regexp_extract("path", r"([^/]+)\.xml$", 1).alias("name"), F.decode("content", "UTF-8").alias("content"))


class _Element(ET.Element):
    line = 0


def _tree(content: str) -> ET.Element:
    """The root, with every element's source line."""
    builder, parser = ET.TreeBuilder(element_factory=_Element), expat.ParserCreate(None, "}")
    name = lambda n: "{" + n if "}" in n else n

    def start(tag: str, attributes: dict) -> None:
        builder.start(name(tag), {name(k): v for k, v in attributes.items()}).line = parser.CurrentLineNumber

    parser.StartElementHandler, parser.EndElementHandler = start, lambda tag: builder.end(name(tag))
    parser.CharacterDataHandler = builder.data
    parser.Parse(content, True)
    return builder.close()


class Document:
    """A parsed document with the parent axis that ElementTree lacks."""

    def __init__(self, content: str, base: str | None = None):
        self.root = _tree(content)
        if base:
            folder = os.path.dirname(base.removeprefix("file:"))

            def load(href: str, parse: str, encoding: str | None = None):
                with open(os.path.join(folder, href), encoding=encoding or "utf-8") as f:
                    return _tree(f.read()) if parse == "xml" else f.read()

            ElementInclude.include(self.root, loader=load)
        self.parent = {c: p for p in self.root.iter() for c in p}

    def above(self, e: ET.Element, tag: str | None = None) -> Iterator[ET.Element]:
        while (e := self.parent.get(e)) is not None:
            if tag is None or e.tag == _TEI + tag:
                yield e

    def all(self, tag: str) -> Iterator[ET.Element]:
        return self.root.iter(_TEI + tag)


def _line(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


def _id(x: str | None) -> str | None:
    return (x or "").lstrip("#").strip() or None


def _ids(x: str | None) -> list[str]:
    return [i for i in map(_id, (x or "").split()) if i]


def _refs(doc: Document, p: ET.Element, tag: str) -> list[str]:
    """Pointers of the mentions in p that stand in no note."""
    note = _TEI + "note"
    inside = (e for e in p.iter(_TEI + tag) if e.get("ref") and not any(a.tag == note for a in doc.above(e)))
    return [i for e in inside for i in _ids(e.get("ref"))]


def _contributor(doc: Document, p: ET.Element) -> str | None:
    """Byline, else signature, of the innermost text division that has one."""
    for div in doc.above(p, "div"):
        found = div.findall(_TEI + "byline") or [e for e in div if e.tag == _TEI + "signed" or e.tag == _TEI + "closer"]
        found = [s for e in found for s in (e.findall(_TEI + "signed") if e.tag == _TEI + "closer" else [e])]
        if found:
            refs = [e.get("ref") for e in found[0].iter(_TEI + "persName") if e.get("ref")]
            if refs and (ids := _ids(refs[0])):
                return ids[0]
            return re.sub(r"^por\s+", "", _line("".join(found[0].itertext())).lower()) or None
    return None


PARAGRAPHS = "para_id string, issue string, place int, div_id string, div_type string, div_subtype string, text_id string, contributor string, text string, persons array<string>, places array<string>, ana_gold array<string>, has_note boolean"


def paragraph_rows(name: str, content: str, base: str | None = None) -> list[dict]:
    """One row per paragraph in document order; its text includes that of notes."""
    doc, rows = Document(content, base), []
    for place, p in enumerate(doc.all("p")):
        divs = list(doc.above(p, "div"))
        typed = next((d for d in divs if d.get("type")), None)
        own = next((d for d in divs if d.get(_XML + "id")), divs[-1] if divs else None)
        text_id = f"{name}_orphan" if own is None else own.get(_XML + "id") or f"{name}_pos{own.line}"
        rows.append({
            "para_id": p.get(_XML + "id"), "issue": name, "place": place,
            "div_id": typed.get(_XML + "id") if typed is not None else None, "div_type": typed.get("type") if typed is not None else None,
            "div_subtype": typed.get("subtype") if typed is not None else None, "text_id": text_id, "contributor": _contributor(doc, p),
            "text": _line("".join(p.itertext())), "persons": _refs(doc, p, "persName"), "places": _refs(doc, p, "placeName"),
            "ana_gold": _ids(p.get("ana")), "has_note": next(p.iter(_TEI + "note"), None) is not None,
        })
    return rows


def concept_rows(name: str, content: str, base: str | None = None) -> list[dict]:
    doc = Document(content, base)
    return [{"id": e.get(_XML + "id"), "label": _line("".join(e.itertext()))} for g in doc.all("interpGrp") for e in g.findall(_TEI + "interp") if e.get(_XML + "id")]


def _name(person: ET.Element) -> str:
    """Given forenames, else all, with the first surname; else the surname; else the whole name."""
    fore = [e.text for e in person.iter(_TEI + "forename") if e.get("type") == "given" and e.text] or [e.text for e in person.iter(_TEI + "forename") if e.text]
    sur = [e.text for e in person.iter(_TEI + "surname") if e.text]
    if sur:
        return " ".join(x for x in (s.strip() for s in [*fore, sur[0]]) if x)
    return _line("".join("".join(e.itertext()) for e in person.iter(_TEI + "persName")))


def person_rows(name: str, content: str, base: str | None = None) -> list[dict]:
    """Persons with raw dates and places, to be joined with dimensions."""
    out = []
    for e in Document(content, base).all("person"):
        if not (pid := e.get(_XML + "id")):
            continue
        first = lambda path, key=None: next((x.get(key) if key else x.text for x in e.iterfind(path) if (x.get(key) if key else x.text)), None)  # noqa: B023, E731
        out.append({
            "id": pid, "name": _name(e), "birth": first(f".//{_TEI}birth/{_TEI}date", "when"), "death": first(f".//{_TEI}death/{_TEI}date", "when"),
            "place": _id(first(f".//{_TEI}birth/{_TEI}placeName", "ref")), "wikidata": first(f".//{_TEI}idno[@subtype='wikidata']"),
        })
    return out


def place_rows(name: str, content: str, base: str | None = None) -> list[dict]:
    got = ((e.get(_XML + "id"), e.find(f"{_TEI}location/{_TEI}country")) for e in Document(content, base).all("place"))
    return [{"id": i, "country": c.text.strip()} for i, c in got if i and c is not None and c.text]


def note_rows(name: str, content: str, base: str | None = None) -> list[dict]:
    """One row per note: whether the editor's, whether in a paragraph."""
    doc = Document(content, base)
    return [{"issue": name, "editor": "#ED" in (e.get("resp") or "").split(), "inside": next(doc.above(e, "p"), None) is not None} for e in doc.all("note")]


def title_rows(name: str, content: str, base: str | None = None) -> list[dict]:
    """(text_id, title): the first non-empty head of the divisions of one key."""
    out: dict[str, str] = {}
    for div in Document(content, base).all("div"):
        key = div.get(_XML + "id") or f"{name}_pos{div.line}"
        head = div.find(_TEI + "head")
        out[key] = out.get(key) or (_line("".join(head.itertext())) if head is not None else "")
    return [{"text_id": k, "title": v} for k, v in out.items()]


SCHEMAS = {
    paragraph_rows: PARAGRAPHS, concept_rows: "id string, label string", person_rows: "id string, name string, birth string, death string, place string, wikidata string",
    place_rows: "id string, country string", note_rows: "issue string, editor boolean, inside boolean", title_rows: "text_id string, title string",
}


_KINDS = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
#: Rows given on at once, and characters of documents after which they are given on.
BATCH, CHARS = 4096, 16 << 20


def extracted(docs: DataFrame, rows, includes: bool = False) -> DataFrame:
    """Rows of one of this module's row functions from (path, name, content); null contents give none.

    With `includes`, XInclude references are read relative to each path, which every executor must reach.
    """
    schema = SCHEMAS[rows]
    fields = pa.schema([(c.split()[0], _KINDS[c.split()[1]]) for c in schema.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, held = [], 0
            for path, name, content in zip(*(b.column(k).to_pylist() for k in range(3))):
                if content is not None:
                    out += rows(name, content, path if includes else None)
                    held += len(content)
                if len(out) >= BATCH or held >= CHARS:
                    yield pa.RecordBatch.from_pylist(out, schema=fields)
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=fields)

    return docs.select("path", "name", "content").mapInArrow(run, schema)


def note_counts(notes: DataFrame) -> DataFrame:
    """One row: all notes, the editor's, the editor's in paragraphs, all in paragraphs."""
    e, i = F.col("editor"), F.col("inside")
    return notes.agg(F.count("*").alias("n_notes"), F.count_if(e).alias("n_ed"), F.count_if(e & i).alias("n_ed_in_p"), F.count_if(i).alias("n_notes_in_p"))
