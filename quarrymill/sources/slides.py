"""Slide decks and extracted page text to ``(heading path, text)`` sections."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from xml.etree import ElementTree as ET

from quarrymill import config as C

# The formats' own names.
TEXT = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
PRESENTATION = "ppt/presentation.xml"
BREAKS = {f"{TEXT}br": "\n", f"{TEXT}tab": "\t"}
NOISE = re.compile("|".join([r"^click to add\b", r"^©\s*\d{4}", r"^\d+\s*/\s*\d+$", r"^\d+$", *C.BOILERPLATE]), re.IGNORECASE)


def part(book: zipfile.ZipFile, name: str) -> ET.Element | None:
    """A part's XML; None where it is missing or broken."""
    try:
        return ET.fromstring(book.read(name))
    except (KeyError, ET.ParseError):
        return None


def related(book: zipfile.ZipFile, name: str) -> dict[str, tuple[str, str]]:
    """``id: (kind, part)`` of what a part refers to."""
    folder, file = posixpath.split(name)
    tree = part(book, f"{folder}/_rels/{file}.rels")
    entries = [x.attrib for x in tree] if tree is not None else []
    # join() lets a target from the root replace the folder
    return {a.get("Id", ""): (a.get("Type", "").rsplit("/", 1)[-1], posixpath.normpath(posixpath.join(f"/{folder}", a.get("Target", ""))).lstrip("/")) for a in entries}


def slide_parts(book: zipfile.ZipFile) -> list[str]:
    """Slides as they are shown; those that the presentation doesn't name follow by number."""
    number = {n: int(m[1]) for n in book.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n))}
    tree, known = part(book, PRESENTATION), related(book, PRESENTATION)
    shown = [known[i][1] for x in (tree.iter() if tree is not None else ()) if (i := x.get(RELATION)) in known]
    return list(dict.fromkeys([*(n for n in shown if n in number), *sorted(number, key=number.get)]))


def paragraphs(tree: ET.Element | None) -> list[str]:
    """Lines of text without placeholders and boilerplate."""
    found = [] if tree is None else ["".join(x.text or "" if x.tag == f"{TEXT}t" else BREAKS.get(x.tag, "") for x in p.iter()) for p in tree.iter(f"{TEXT}p")]
    lines = [re.sub(r"[ \t]+", " ", f).strip() for f in found]
    return [x for x in lines if x and not NOISE.match(x)]


def slide_sections(data: bytes | None) -> list[tuple[list[str], str]]:
    """A section for each slide with text, its speaker notes behind it; no sections for what is no deck."""
    try:
        book = zipfile.ZipFile(io.BytesIO(data or b""))
    except zipfile.BadZipFile:
        return []
    out = []
    with book:
        for n, name in enumerate(slide_parts(book), 1):
            blocks = paragraphs(part(book, name))
            notes = [to for kind, to in related(book, name).values() if kind == "notesSlide"]
            if notes and (said := paragraphs(part(book, notes[0]))):
                blocks.append("\n".join(["Speaker notes:", *said]))
            if blocks:
                out.append(([f"Slide {n}"], "\n\n".join(blocks)))
    return out


def heading(text: str) -> bool:
    """Short, no sentence end, and capitals or capitalised words; a number is one too."""
    return len(text) <= 120 and len(text.split()) <= 12 and text[-1] not in ".!?:" and text in (text.title(), text.upper())


def page_sections(text: str | None, title: str = "") -> tuple[str, list[tuple[list[str], str]]]:
    """Title and sections of extracted text with a form feed between pages: a section for each page, under its number and its last heading.

    The first paragraph of page 1 with at most 12 words that differs from ``title`` is the title. A text without
    sections has one, the title.
    """
    out, named = [], title
    for n, page in enumerate((text or "").split("\f"), 1):
        path, body = [f"Page {n}"], []
        for p in re.split(r"\n\s*\n", page):
            block = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", re.sub(r"\r\n?", "\n", p))).strip()
            if not block:
                continue
            if n == 1 and named == title and len(block.split()) <= 12:
                named = block
            elif heading(block):
                path = [f"Page {n}", block]
            elif not NOISE.match(block):
                body.append(block)
        if body:
            out.append((path, "\n\n".join(body)))
    return named, out or ([([], title)] if title else [])
