"""Documents to sections: HTML, Markdown, notebooks, slides and paged text, one row per section.

Parsing is sequential within a document, so it runs in Python over Arrow batches
(``mapInArrow``); documents are spread by their partitions and no document meets
another.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrymill import config as C
from quarrymill.sources.slides import page_sections, slide_sections

#: Title, and ``(heading path, text, anchor)`` of each section.
Parsed = tuple[str, list[tuple[list[str], str, str | None]]]
BOILERPLATE = re.compile("|".join([r"©\s*\d{4}", r"\d+\s*/\s*\d+$", r"\d+$", *C.BOILERPLATE]), re.IGNORECASE)

# Names of HTML elements.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
DROPPED = {"script", "style", "noscript", "template", "svg", "nav", "header", "footer", "aside", "form"}
HEADINGS = {f"h{i}": i for i in range(1, 7)}
BLOCKS = set(HEADINGS) | {"p", "li", "pre", "code", "table"}
#: Marks among a table's words: here a row begins, here a cell.
ROW, CELL = "\0", "\1"


def format_of(content: Column, url: Column, kind: Column | None = None) -> Column:
    """The parser that a document goes to, by its content type where one is known, its address and its content."""
    u = F.lower(F.regexp_replace(url, r"[?#].*$", ""))
    said = F.lower(F.coalesce(F.lit("") if kind is None else kind, F.lit("")))
    out = F.when(said.contains("pdf") | u.endswith(".pdf"), "pdf").when(said.contains("presentationml") | u.endswith(".pptx"), "pptx").when(said.contains("ipynb") | u.endswith(".ipynb"), "notebook")
    return out.when(said.contains("markdown") | u.rlike(r"\.(md|markdown)$"), "markdown").when(said.contains("html") | F.lower(content).contains("<html"), "html").otherwise("markdown")


def clean(text: str) -> str:
    """Line ends, runs of blanks and of empty lines put in order."""
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", re.sub(r"\r\n?", "\n", text or ""))).strip()


def resolve(base: str, href: str | None) -> str | None:
    """A link's address (RFC 3986); mail, telephone and script links have none."""
    href = (href or "").strip()
    if not href or href.lower().startswith(("mailto:", "tel:", "javascript:")):
        return None
    try:
        return urljoin(base, href)
    except ValueError:
        return None


def with_links(text: str, links: list[tuple[str, str | None]]) -> str:
    """A block's text, and behind it what it links to."""
    said = " ".join(f"{clean(t)} {u}" for t, u in links if clean(t) and u)
    return clean(f"{text}\n\nLinked references: {said}") if said else text


def under(path: list[tuple[str, str | None]], level: int, text: str, anchor: str | None) -> list[tuple[str, str | None]]:
    """The headings above a section: a heading of level n replaces all from the n-th on."""
    return [*path[: level - 1], (text, anchor or None)]


def section(path: list[tuple[str, str | None]], blocks: list[str]) -> tuple[list[str], str, str | None]:
    return [t for t, _ in path], "\n\n".join(blocks), next((a for _, a in reversed(path) if a), None)


class Blocks(HTMLParser):
    """Outermost blocks of a page, in order, with tag, id and links of each; dropped parts are skipped.

    The root is the first main part, article or content; it holds a run of the blocks.
    """

    def __init__(self):
        super().__init__()
        self.stack: list[str] = []
        self.found: list[tuple[str, list[str], str | None, list[tuple[str, list[str]]]]] = []
        self.open: int | None = None
        self.link: list[str] | None = None
        self.title: list[str] = []
        self.named = ""
        self.loose: list[str] = []
        self.roots: dict[int, list] = {}  # by preference: depth, first block, end

    def blocks(self) -> list:
        _, at, to = self.roots[min(self.roots)] if self.roots else (0, 0, None)
        return self.found[at:to]

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        if tag == "meta" and attrs.get("property") == "og:title":
            self.named = self.named or clean(attrs.get("content") or "")
        if tag in VOID:
            return
        self.stack.append(tag)
        classes = (attrs.get("class") or "").split()
        for rank, met in enumerate((tag == "main", tag == "article", attrs.get("role") == "main", "article" in classes, "content" in classes, tag == "body")):
            if met and not self.dropped():
                self.roots.setdefault(rank, [len(self.stack), len(self.found), None])
        if tag in BLOCKS and self.open is None and not self.dropped():
            self.open = len(self.stack)
            self.found.append((tag, [], attrs.get("id"), []))
        elif tag in ("tr", "td", "th") and self.open is not None and self.found[-1][0] == "table" and not self.dropped():
            self.found[-1][1].append(ROW if tag == "tr" else CELL)
        if tag == "a" and attrs.get("href") is not None and self.open is not None and not self.dropped():
            self.link = []
            self.found[-1][3].append((attrs["href"], self.link))

    def handle_endtag(self, tag):
        if tag == "a":
            self.link = None
        if tag in self.stack:
            while self.stack.pop() != tag:
                pass
            if self.open is not None and len(self.stack) < self.open:
                self.open = self.link = None
            for root in self.roots.values():
                if root[2] is None and len(self.stack) < root[0]:
                    root[2] = len(self.found)

    def dropped(self) -> bool:
        return any(t in DROPPED for t in self.stack)

    def handle_data(self, data):
        if "title" in self.stack:
            self.title.append(data)
        elif data.strip() and not self.dropped():
            words = self.loose if self.open is None else self.found[-1][1]
            words.append(data.strip("\n") if self.open is not None and self.found[-1][0] == "pre" else data.strip())
            if self.link is not None:
                self.link.append(data.strip())


def block_text(tag: str, words: list[str]) -> str:
    """Code in a fence, tables a line for each row, all else in one line."""
    one = lambda t: re.sub(r"\s+", " ", t).strip()
    if tag in ("pre", "code"):
        body = "\n".join(words).strip("\n") if tag == "pre" else one(" ".join(words))
        return f"```\n{body}\n```" if body.strip() else ""
    if tag == "table":
        rows = [" | ".join(filter(None, map(one, r.split(CELL)))) for r in " ".join(words).split(ROW)]
        return "\n".join(filter(None, rows))
    return one(" ".join(words))


def parse_html(text: str, url: str = "", title: str = "") -> Parsed:
    """Sections of a page under its headings, without boilerplate, with link evidence.

    The title is the first heading of level 1, else the page's social or own title.
    """
    p = Blocks()
    p.feed(text or "")
    p.close()
    title = p.named or clean(re.sub(r"\s+", " ", " ".join(p.title))) or title
    path, out, first = [], [([], [])], True
    for tag, words, anchor, links in p.blocks():
        body = block_text(tag, words)
        if not body or BOILERPLATE.match(clean(" ".join(words))):
            continue
        if tag in HEADINGS:
            path = under(path, HEADINGS[tag], body, clean(anchor or ""))
            out.append((path, []))
            if HEADINGS[tag] == 1 and first:
                title, first = body, False
        else:
            shown = [(" ".join(t), resolve(url, to)) for to, t in links]
            out[-1][1].append(body if tag in ("pre", "code") else with_links(f"- {body}" if tag == "li" else body, shown))
    found = [section(h, b) for h, b in out if b]
    return title, found or ([([], re.sub(r"\s+", " ", " ".join(p.loose)), None)] if p.loose else [])


def html_sections(text: str) -> list[tuple[list[str], str]]:
    """``(heading path, text)`` of the sections of a page."""
    return [(h, t) for h, t, _ in parse_html(text)[1]]


def without_frontmatter(text: str) -> str:
    text = text.removeprefix("\ufeff")
    end = text.find("\n---", 3) if text.startswith("---") else -1
    return text[end + 4 :].lstrip() if end >= 0 else text


def parse_markdown(text: str, url: str = "", title: str = "") -> Parsed:
    """Sections of a Markdown document: no front matter, no boilerplate, anchors off headings, links behind their paragraph; fences hide headings."""
    text = without_frontmatter(text or "")
    path, out, lines, code, own = [], [([], [])], [], [], title

    def flush() -> None:
        body = clean("\n".join(lines))
        lines.clear()
        if body and not BOILERPLATE.match(body):
            out[-1][1].append(with_links(body, [(t, resolve(url, u)) for t, u in re.findall(r"(?<!!)\[([^\]]+)\]\(([^)\s]+)(?:\s+\"[^\"]*\")?\)", body)]))

    for line in text.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        if re.match(r"```|~~~", line.strip()):
            if code:
                out[-1][1].append("\n".join([*code, line]).strip())
                code = []
            else:
                flush()
                code = [line]
        elif code:
            code.append(line)
        elif head := re.match(r"(#{1,6})\s+(.*)$", line.strip()):
            flush()
            name = clean(head[2])
            anchor = re.match(r"(.*?)\s*\{#([A-Za-z0-9_-]+)\}\s*$", name)
            if anchor:
                name = clean(anchor[1])
            if len(head[1]) == 1 and own == title:
                own = name
            path = under(path, len(head[1]), name, anchor and anchor[2])
            out.append((path, []))
        elif line.strip():
            lines.append(line)
        else:
            flush()
    flush()
    if code:
        out[-1][1].append("\n".join(code).strip())
    found = [section(h, b) for h, b in out if b]
    return own, found or ([([], clean(text), None)] if clean(text) else [])


def markdown_sections(text: str) -> list[tuple[list[str], str]]:
    """``(heading path, text)`` of the sections of a Markdown document."""
    return [(h, t) for h, t, _ in parse_markdown(text)[1]]


def output_text(o: dict) -> str:
    """What a notebook cell put out: its stream, its error, or its data in the fittest form."""
    whole = lambda x: "".join(map(str, x)) if isinstance(x, list) else str(x or "")
    if o.get("output_type") == "error":
        return whole(o.get("traceback")) or clean(f"{o.get('ename') or ''} {o.get('evalue') or ''}")
    data = o.get("data") if isinstance(o.get("data"), dict) else {}
    return whole(o.get("text") or data.get("text/markdown") or data.get("text/plain") or data.get("text/html"))


def notebook_markdown(text: str) -> str:
    """A notebook as Markdown: its text cells, and code and text outputs in fences."""
    try:
        book = json.loads(text)
    except ValueError:
        return text or ""
    if not isinstance(book, dict) or not ("cells" in book or "worksheets" in book):
        return text or ""
    whole = lambda x: "".join(x) if isinstance(x, list) else str(x or "")
    cells = book.get("cells") or [c for w in book.get("worksheets", []) for c in w.get("cells", [])]
    language = book.get("metadata", {}).get("kernelspec", {}).get("language", "python")
    out = []
    for c in cells:
        source = whole(c.get("source", c.get("input")))
        if c.get("cell_type") == "code":
            out.append(f"```{language}\n{source}\n```")
            out.extend(f"```\n{body.strip()}\n```" for o in c.get("outputs", []) if isinstance(o, dict) and (body := output_text(o)).strip())
        elif source.strip():
            out.append(source)
    return "\n\n".join(out)


def titled(found: list[tuple[list[str], str]], title: str, first: bool = False) -> Parsed:
    """Sections without anchors; a short first line may be the title."""
    line = next((t for _, body in found for t in body.split("\n") if t.strip()), "") if first else ""
    return line if line and len(line.split()) <= 12 else title, [(h, t, None) for h, t in found]


def parse_topic(text: str, url: str = "", title: str = "") -> Parsed:
    """A documentation service's JSON: a page in base64, under ``topic`` or at the top; what isn't that has no sections."""
    try:
        data = json.loads(text or "")
        topic = data.get("topic", data)
        page = base64.b64decode(topic.get("content") or "").decode("utf-8", "ignore")
    except (ValueError, AttributeError, TypeError):
        return title, []
    return parse_html(page, url, data.get("title") or title) if page else (title, [])


def parse_pages(text: str, url: str = "", title: str = "") -> Parsed:
    named, found = page_sections(text, title)
    return named, [(h, t, None) for h, t in found]


PARSERS = {"topic": parse_topic, "html": parse_html, "markdown": parse_markdown, "notebook": lambda t, u, n: parse_markdown(notebook_markdown(t), u, n), "pdf": parse_pages, "pptx": lambda t, u, n: titled(slide_sections(t), n, True)}


def readable(form: str, content: str | bytes | None) -> str | bytes | None:
    """Bytes for slides, text for all others; bytes that are no UTF-8 are left out, and raw PDF has no text."""
    if form == "pptx":
        return content if isinstance(content, bytes) else None
    text = content.decode("utf-8", "ignore") if isinstance(content, bytes) else content or ""
    return "" if text.startswith("%PDF-") else text


def sections(docs: DataFrame, keep: list[str] | None = None, empty: bool = False) -> DataFrame:
    """``(id, format, content)``, and ``url`` and ``title`` where known, to ``id, n, heading_path, text, title, anchor, url``.

    The columns of ``keep`` follow. Other formats and empty documents give no rows, or one without
    a number if ``empty`` asks for it.
    """
    has = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c) if c in docs.columns else F.lit("").alias(c)
    kinds = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string()]
    names, keep = ["id", "n", "heading_path", "text", "title", "anchor", "url"], keep or []
    base = docs.select("id", "format", "content", has("url"), has("title"), *(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 200):
                rows, of = [], []
                for k, (i, form, content, url, title) in enumerate(zip(*(b.column(k).slice(at, 200).to_pylist() for k in range(5)), strict=True)):
                    named, found = PARSERS[form](readable(form, content), url, title) if form in PARSERS else (title, [])
                    mine = [(i, n, " > ".join(h), t, named, anchor, url) for n, (h, t, anchor) in enumerate(found)] or [(i, None, None, None, named, None, url)] * empty
                    rows += mine
                    of += [at + k] * len(mine)
                own = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([*own, *(c.take(pa.array(of, pa.int64())) for c in b.columns[5:])], [*names, *(f"k{i}" for i in range(len(keep)))])

    fields = [T.StructField(n, t) for n, t in zip(names, [T.LongType(), T.IntegerType(), *[T.StringType()] * 5], strict=True)]
    out = base.mapInArrow(run, T.StructType(fields + base.schema.fields[5:]))
    return out.select(*names, *(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)))
