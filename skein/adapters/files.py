"""File extraction: registration (MIME type, front-matter tags, status), structural analysis, then semantic extraction.

Files come as rows (path, length, content) of Spark's ``binaryFile`` source. Front matter (YAML) and Markdown are parsed
in Python, in Arrow batches; all else are columns.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import concept, edge, js, node, now, props
from ..operators.write import Emission

KIND = ADAPTER = "extract-file"
OCTETS = "application/octet-stream"
MIME = {
    "text/markdown": ("md", "markdown"),
    "text/plain": ("txt",),
    "text/x-rust": ("rs",),
    "text/x-python": ("py",),
    "text/javascript": ("js",),
    "text/typescript": ("ts",),
    "text/html": ("html", "htm"),
    "text/css": ("css",),
    "application/json": ("json",),
    "text/yaml": ("yaml", "yml"),
    "text/toml": ("toml",),
    "audio/mpeg": ("mp3",),
    "audio/wav": ("wav",),
    "audio/ogg": ("ogg",),
    "audio/flac": ("flac",),
    "image/jpeg": ("jpg", "jpeg"),
    "image/png": ("png",),
    "image/gif": ("gif",),
    "image/svg+xml": ("svg",),
    "application/pdf": ("pdf",),
}
SECTIONS = "array<struct<label: string, start_line: bigint, end_line: bigint>>"


def mime_type(path: Column) -> Column:
    """By the extension, whose letters count as they are; a name that begins with its only dot has none."""
    ext = F.regexp_extract(path, r"[^/.][^/]*?\.([^./]*)$", 1)
    kinds = F.create_map(*[F.lit(x) for m, es in MIME.items() for e in es for x in (e, m)])
    return F.coalesce(F.try_element_at(kinds, ext), F.lit(OCTETS))


# -- front matter ------------------------------------------------------------------------------------------------------
def front_matter(content: str) -> tuple[object | None, str | None]:
    """(parsed YAML, warning) of the block between ``---`` lines at the head of a text; both None without one."""
    import yaml

    text = content.lstrip()
    end = text.find("\n---", 3)
    if not text.startswith("---") or end < 0:
        return None, None
    try:
        return yaml.safe_load(text[3:end]), None
    except yaml.YAMLError as e:
        return None, f"YAML parse error: {e}".split("\n")[0]


def tags_of(matter: object) -> list[str]:
    """Tags in lower case: a list's strings, or a string's parts between commas."""
    tags = matter.get("tags") if isinstance(matter, dict) else None
    if isinstance(tags, str):
        return [t for x in tags.split(",") if (t := x.strip().lower())]
    return [t.lower() for t in tags if isinstance(t, str)] if isinstance(tags, list) else []


def described(files: DataFrame) -> DataFrame:
    """(path, length, mime, tags, warning). Contents that aren't UTF-8 have neither tags nor warning."""

    def parse(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = []
            for c in b["content"]:
                try:
                    found.append(front_matter(bytes(c).decode()) if c is not None else (None, None))
                except UnicodeDecodeError:
                    found.append((None, None))
            yield pd.DataFrame({"path": b["path"], "length": b["length"], "tags": [tags_of(m) for m, _ in found], "warning": [w for _, w in found]})

    d = files.select("path", "length", "content").mapInPandas(parse, "path string, length bigint, tags array<string>, warning string")
    return d.withColumn("mime", mime_type(F.col("path")))


def registration(files: DataFrame, stamp: Column | None = None) -> Emission:
    """File nodes, their tags as concepts (``tagged_with``), and a status node for each file."""
    stamp = now() if stamp is None else stamp
    d, path = described(files), F.col("path")
    file_id, complete, pending = F.concat(F.lit("file:"), path), F.lit("complete"), F.lit("pending")
    nodes = d.select(*node(file_id, "file", "document", "structure", props(path=path, mime_type=F.col("mime"), file_size=F.col("length"), created_at=stamp)))
    status = props(file_path=path, registration=complete, structural_analysis=pending, semantic_extraction=pending, created_at=stamp, registration_warning=F.col("warning"))
    nodes = nodes.unionByName(d.select(*node(status_id(path), "extraction-status", "document", "structure", status)))
    t = d.select("path", F.posexplode("tags").alias("i", "tag"))
    nodes = nodes.unionByName(t.select(*concept(F.col("tag"), created_at=stamp)).dropDuplicates(["id"]))
    edges = t.select(*edge(file_id, F.concat(F.lit("concept:"), F.lower("tag")), "tagged_with", "structure", "semantic", F.col("i")))
    return Emission(nodes=nodes, edges=edges)


def status_id(path: Column) -> Column:
    return F.concat(F.lit("extraction-status:"), path)


def status(paths: DataFrame, phase: str, value: str | Column) -> Emission:
    """A phase's state on the status nodes of files (path): an update of their properties."""
    v = value if isinstance(value, Column) else F.lit(value)
    return Emission(updates=paths.select(status_id(F.col("path")).alias("id"), F.create_map(F.lit(phase), js(v)).alias("properties")))


# -- structure ---------------------------------------------------------------------------------------------------------
@dataclass(frozen=True)
class Module:
    """A structural module: runs on files whose MIME type begins with ``affinity``. ``analyze`` gets path and content and
    returns (vocabulary, sections (label, start, end))."""

    id: str
    affinity: str
    analyze: Callable[[str, str], tuple[list[str], list[tuple[str, int, int]]]]


ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
FENCE = re.compile(r" {0,3}(`{3,}|~{3,})[ \t]*([^`]*)$")
SETEXT = re.compile(r" {0,3}(=+|-+)[ \t]*$")
LINK = re.compile(r"!?\[((?:[^\[\]\\]|\\.)*)\](?:\([^()]*(?:\([^()]*\)[^()]*)*\)|\[[^\]]*\])|<((?:https?|mailto):[^ <>]+)>")
RULE = re.compile(r" {0,3}(?:(?:-[ \t]*){3,}|(?:\*[ \t]*){3,}|(?:_[ \t]*){3,})$")
NOT_TEXT = re.compile(r" {0,3}(?:[-*+>]|\d{1,9}[.)]|(?:[-*_][ \t]*){3,}$)")


def plain(s: str) -> str:
    """Text of inline Markdown: code spans, emphasis and links by what they show."""
    s = LINK.sub(lambda m: m[1] if m[1] is not None else m[2], s)
    s = re.sub(r"(`+)(.+?)\1", lambda m: m[2].strip() or m[2], s)
    s = re.sub(r"(?<!\\)(\*\*|__|\*|(?<!\w)_|~~)(?=\S)(.+?)(?<=\S)\1", r"\2", s)
    return re.sub(r"\\([!-/:-@\[-`{-~])", r"\1", s)


def markdown(path: str, content: str) -> tuple[list[str], list[tuple[str, int, int]]]:
    """Vocabulary (headings, link texts, languages of fences; lower case, first of equal ones) and sections: from each
    heading to the line before the next of any level, the last to the end."""
    words: dict[str, None] = {}
    heads: list[tuple[str, int]] = []
    lines = content.split("\n")
    total = len(lines) - (lines[-1] == "")
    fence, paragraph, begun = None, [], 0

    def say(s: str) -> None:
        if s := s.strip():
            words.setdefault(s.lower())

    def links(s: str) -> None:
        for m in LINK.finditer(re.sub(r"(`+).+?\1", "", s) if "`" in s and "[" not in s else s):
            if not m[0].startswith("!"):
                say(plain(m[1] if m[1] is not None else m[2]))

    def flush() -> None:
        if paragraph:
            links("\n".join(paragraph))
        paragraph.clear()

    for k, raw in enumerate(lines, 1):
        line = raw.rstrip("\r")
        if fence:
            if (m := FENCE.match(line)) and m[1][0] == fence[0] and len(m[1]) >= len(fence) and not m[2].strip():
                fence = None
            continue
        if (m := FENCE.match(line)) and (m[1][0] == "~" or "`" not in m[2]):
            flush()
            fence = m[1]
            say(m[2])
        elif m := ATX.match(line):
            flush()
            if label := plain(m[2] or "").strip():
                say(label)
                heads.append((label, k))
        elif paragraph and (m := SETEXT.match(line)):
            label, paragraph[:] = plain(" ".join(x.strip() for x in paragraph)).strip(), []
            if label:
                say(label)
                heads.append((label, begun))
        elif RULE.match(line):
            flush()
        elif not line.strip() or (not paragraph and line.startswith(("    ", "\t"))):
            flush()
        else:
            if NOT_TEXT.match(line) and not SETEXT.match(line):
                flush()
                links(line)
                continue
            begun = begun if paragraph else k
            paragraph.append(line)
    flush()
    ends = [max(s, h[1] - 1) for h, (_, s) in zip(heads[1:], heads)] + [total]
    return list(words), [(label, start, end) for (label, start), end in zip(heads, ends)]


MARKDOWN = Module("extract-analysis-text-markdown", "text/markdown", markdown)


def structure(files: DataFrame, modules: Sequence[Module] = (MARKDOWN,)) -> DataFrame:
    """(path, vocabulary, sections): what all matching modules found, merged: words without regard to case, the first
    spelling stays; sections by their first line. Files that no module matches have both empty."""
    mods = tuple(modules)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            words, sections = [], []
            for path, mime, c in zip(b["path"], b["mime"], b["content"]):
                v: dict[str, str] = {}
                s: list[tuple[str, int, int]] = []
                for m in mods:
                    if not mime.startswith(m.affinity) or c is None:
                        continue
                    found, parts = m.analyze(path, bytes(c).decode("utf-8", "replace"))
                    for w in found:
                        v.setdefault(w.lower(), w)
                    s += parts
                words.append(list(v.values()))
                sections.append([{"label": a, "start_line": x, "end_line": y} for a, x, y in sorted(s, key=lambda x: x[1])])
            yield pd.DataFrame({"path": b["path"], "vocabulary": words, "sections": sections})

    return files.select("path", mime_type(F.col("path")).alias("mime"), "content").mapInPandas(run, f"path string, vocabulary array<string>, sections {SECTIONS}")


def phases(files: DataFrame, modules: Sequence[Module] = (MARKDOWN,), responses: DataFrame | None = None) -> Iterator[tuple[str, Emission]]:
    """(contributor, emission) of each phase, to be committed in this order: registration; structural analysis, done;
    semantic extraction from supplied ``responses`` (path, agent, response), or skipped for files without any."""
    from . import semantic

    yield ADAPTER, registration(files)
    found = structure(files, modules)
    yield ADAPTER, status(files.select("path"), "structural_analysis", "complete")
    if responses is None:
        yield ADAPTER, status(files.select("path"), "semantic_extraction", "skipped: no client")
        return
    yield semantic.ADAPTER, semantic.emission(responses, found)
    seen = files.select("path").join(responses.select("path").distinct().withColumn("seen", F.lit(True)), "path", "left")
    yield ADAPTER, status(seen, "semantic_extraction", F.when(F.col("seen"), "complete").otherwise("skipped: no response"))
