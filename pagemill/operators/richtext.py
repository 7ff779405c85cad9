"""Rich-text documents and schemaless records: trees of JSON, in Arrow batches.

A document is ``{"type": "doc", "content": [...]}``. Key order is the author's. These are the
operators that columns cannot express; each is a plain function over parsed JSON with a pandas UDF
around it.
"""

from __future__ import annotations

import json
import re
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CONTAINERS = ("blockquote", "table", "tableRow", "tableCell")
#: Keys that wire a record up rather than describe it.
WIRING = ("id", "route", "image")
_ADDRESS = re.compile(r"^(?:[A-Za-z][A-Za-z0-9+.\-]*://\S*|(?:mailto|tel):\S*|\.{0,2}/\S*)$")


def is_doc(value) -> bool:
    return isinstance(value, dict) and value.get("type") == "doc"


def with_captions(node, parent: str = ""):
    """The tree with inset references as their captions; without captions, and placeholders, they go."""
    if not isinstance(node, dict):
        return node
    out = dict(node)
    if isinstance(node.get("content"), list):
        kids = []
        for child in node["content"]:
            kind = child.get("type") if isinstance(child, dict) else None
            if kind == "inset_placeholder":
                continue
            if kind == "inset_ref":
                caption = ((child.get("attrs") or {}).get("alt") or "").strip()
                if caption:
                    text = {"type": "text", "text": caption}
                    kids.append(text if node.get("type") in ("paragraph", "heading") else {"type": "paragraph", "content": [text]})
                continue
            kids.append(with_captions(child))
        out["content"] = kids
    return out


def plain(node) -> str:
    """All text below a node, joined without separators."""
    if not isinstance(node, dict):
        return ""
    return (node.get("text") or "") + "".join(plain(c) for c in node.get("content") or [])


def _links(node) -> list[str]:
    return [c["text"].strip() for c in node.get("content") or [] if isinstance(c, dict) and (c.get("text") or "").strip() and any((m or {}).get("type") == "link" for m in c.get("marks") or [])]


def extract(doc, headings=True, paragraphs=True, links=True, lists=True, alts=True) -> tuple[str | None, list[str]]:
    """Title (the first level-1 heading that is no pretitle) and the searchable parts, in order."""
    title, parts = None, []

    def put(text: str) -> None:
        if text.strip():
            parts.append(text.strip())

    def walk(nodes) -> None:
        nonlocal title
        for node in nodes or []:
            if not isinstance(node, dict):
                continue
            kind, attrs = node.get("type"), node.get("attrs") or {}
            if kind == "heading":
                text = plain(node).strip()
                if title is None and text and attrs.get("level") == 1 and attrs.get("role") != "pretitle":
                    title = text
                if headings:
                    put(text)
            elif kind == "paragraph":
                if paragraphs:
                    put(plain(node))
                if links:
                    for label in _links(node):
                        put(label)
            elif kind in ("bulletList", "orderedList"):
                if lists:
                    for item in node.get("content") or []:
                        for p in (item or {}).get("content") or []:
                            if (p or {}).get("type") == "paragraph":
                                put(plain(p))
            elif kind == "image":
                if alts:
                    put(attrs.get("alt") or "")
            elif kind in CONTAINERS:
                walk(node.get("content"))

    walk((with_captions(doc) or {}).get("content") if is_doc(doc) else [])
    return title, parts


WRITABLE = {"doc", "paragraph", "heading", "text", "bulletList", "orderedList", "listItem", "blockquote", "codeBlock", "image", "hardBreak", "horizontalRule", "table", "tableRow", "tableCell", "tableHeader", "math_display", "inset_ref", "inset_placeholder"}


def writable(node) -> bool:
    return not isinstance(node, dict) or (node.get("type") in WRITABLE and all(writable(c) for c in node.get("content") or []))


def _inline(nodes) -> str:
    out = []
    for n in nodes or []:
        kind = n.get("type")
        if kind == "hardBreak":
            out.append("  \n")
        elif kind == "image":
            attrs = n.get("attrs") or {}
            out.append(f"![{attrs.get('alt') or ''}]({attrs.get('src') or ''})")
        else:
            text = n.get("text") or _inline(n.get("content"))
            for m in n.get("marks") or []:
                mark, attrs = m.get("type"), m.get("attrs") or {}
                text = {"bold": f"**{text}**", "strong": f"**{text}**", "italic": f"*{text}*", "em": f"*{text}*", "code": f"`{text}`"}.get(mark, f"[{text}]({attrs.get('href') or ''})" if mark == "link" else text)
            out.append(text)
    return "".join(out)


def _block(n) -> str:
    kind, attrs, kids = n.get("type"), n.get("attrs") or {}, n.get("content") or []
    if kind == "heading":
        return "#" * int(attrs.get("level") or 1) + " " + _inline(kids)
    if kind in ("bulletList", "orderedList"):
        lines = []
        for i, item in enumerate(kids, 1):
            mark = f"{i}. " if kind == "orderedList" else "- "
            body = "\n".join(_block(c) for c in item.get("content") or [])
            lines.append(mark + body.replace("\n", "\n" + " " * len(mark)))
        return "\n".join(lines)
    if kind == "blockquote":
        return "\n".join(("> " + line).rstrip() for line in _blocks(kids).split("\n"))
    if kind == "codeBlock":
        body = plain(n)
        mark = fence(body)
        return f"{mark}{attrs.get('tag') or attrs.get('language') or ''}\n{body}\n{mark}"
    if kind == "math_display":
        return f"$$\n{plain(n) or attrs.get('latex') or ''}\n$$"
    if kind == "horizontalRule":
        return "---"
    if kind == "table":
        rows = [[" ".join(_block(c) for c in cell.get("content") or []) for cell in row.get("content") or []] for row in kids]
        if not rows:
            return ""
        head, *rest = ["| " + " | ".join(r) + " |" for r in rows]
        return "\n".join([head, "| " + " | ".join("---" for _ in rows[0]) + " |", *rest])
    if kind in ("paragraph", "listItem", "tableCell"):
        return _inline(kids)
    return _inline([n])


def _blocks(nodes) -> str:
    return "\n\n".join(b for b in (_block(n) for n in nodes or [] if isinstance(n, dict)) if b.strip())


def markdown(doc) -> str:
    return _blocks((with_captions(doc) or {}).get("content")).strip() if is_doc(doc) else ""


def fence(body: str) -> str:
    return "`" * max(3, 1 + max((len(x) for x in re.findall("`+", body)), default=0))


def number(value: int | float) -> str:
    """A number as JSON text writes it: no fraction where there is none."""
    if isinstance(value, float) and value.is_integer() and abs(value) < 1e21:
        return str(int(value))
    return re.sub(r"e([+-])0*(\d)", r"e\1\2", repr(value))


def _plain_numbers(value):
    if isinstance(value, float) and value.is_integer() and abs(value) < 1e21:
        return int(value)
    if isinstance(value, dict):
        return {k: _plain_numbers(v) for k, v in value.items()}
    return [_plain_numbers(v) for v in value] if isinstance(value, list) else value


def json_block(value) -> str:
    body = json.dumps(_plain_numbers(value), indent=2, ensure_ascii=False)
    mark = fence(body)
    return f"{mark}json\n{body}\n{mark}"


def _prose(value) -> str:
    """Markdown of a document all of which can be written, else nothing."""
    return markdown(value) if is_doc(value) and isinstance(value.get("content"), list) and writable(value) else ""


def lift(record: dict, path: tuple[str, ...] = ()) -> tuple[dict, list[tuple[tuple[str, ...], str]]]:
    """A record without its rich text, and the texts with their paths; objects emptied by it go."""
    out, texts = {}, []
    for k, v in record.items():
        here = (*path, k)
        if text := _prose(v):
            texts.append((here, text))
        elif isinstance(v, dict) and not is_doc(v):
            rest, found = lift(v, here)
            texts += found
            if rest or not v:
                out[k] = rest
        else:
            out[k] = v
    return out, texts


def record_blocks(value, name: str | None = None) -> list[str]:
    """Markdown blocks of a shown value: its fields as JSON, then its rich texts under their dotted paths.

    A single text in a field ``content`` is the body of an unnamed record and stands without a comment.
    """
    if not isinstance(value, dict):
        return [json_block(value)]
    rest, texts = lift(value)
    body = name is None and len(texts) == 1 and texts[0][0][-1] == "content"
    own = [] if name is None else [name]
    return ([json_block(rest)] if rest else []) + [text if body else f"<!-- {'.'.join([*own, *path])} -->\n\n{text}" for path, text in texts]


def shown_blocks(name: str, value, again: bool) -> list[str]:
    """Blocks of a value that a section shows; one that was written before is only named."""
    if value is None:
        return []
    label = name.replace("--", "-")
    return [f"<!-- {label}: as above -->"] if again else [f"<!-- {label} -->", *record_blocks(value, label)]


def is_address(text: str) -> bool:
    return bool(_ADDRESS.match(text.strip()))


def words_of(value) -> str:
    """Words of a field as they stand: text, finite numbers, lists and documents; never booleans."""
    if isinstance(value, bool) or value is None:
        return ""
    if isinstance(value, str):
        return value
    if isinstance(value, (int, float)):
        return number(value) if value == value and abs(value) != float("inf") else ""
    if isinstance(value, list):
        return " ".join(w for w in map(words_of, value) if w)
    if value.get("type") == "text":
        return value["text"] if isinstance(value.get("text"), str) else ""
    if value.get("type") == "hardBreak":
        return " "
    kids = value.get("content")
    if not isinstance(kids, list):
        return ""
    leaf = lambda c: not isinstance(c, dict) or c.get("type") == "text" or not isinstance(c.get("content"), list)
    return ("" if all(map(leaf, kids)) else " ").join(w for w in map(words_of, kids) if w)


def is_whole(record: dict) -> bool:
    """Whether every own field is a section (an object, no document) or a list of sections."""
    own = [v for k, v in record.items() if not k.startswith("$")]
    section = lambda v: isinstance(v, dict) and not is_doc(v)
    return bool(own) and all(section(v) or (isinstance(v, list) and v and all(map(section, v))) for v in own)


def _section(value) -> bool:
    return isinstance(value, dict) and value.get("type") != "doc"


def fields_of(record: dict) -> dict:
    if not is_whole(record):
        return record
    out = {k: v for k, v in record.items() if k.startswith("$")}
    for k, v in record.items():
        if not k.startswith("$") and _section(v):
            for name, x in v.items():
                out.setdefault(name, x)
    return out


def _deep(section: dict) -> list[str]:
    out = []
    for k, v in section.items():
        if k.startswith("$") or k in WIRING:
            continue
        if _section(v):
            out += _deep(v)
        elif isinstance(v, list) and v and all(map(_section, v)):
            out += [w for x in v for w in _deep(x)]
        elif isinstance(v, str):
            out += [v] if v.strip() and not is_address(v) else []
        elif text := words_of(v):
            out.append(text)
    return out


def searchable_keys(record: dict) -> list[str]:
    """A brief record's plain text fields, in their order."""
    return [k for k, v in record.items() if isinstance(v, str) and v.strip() and not k.startswith("$") and k not in WIRING and not is_address(v)]


def record_text(record: dict, declared: list[str] | None = None) -> str:
    """Search text of a record: declared fields, all of a whole record, or a brief one's plain strings."""
    if declared is not None:
        fields = fields_of(record)
        return " ".join(w for w in (words_of(fields.get(k)) for k in declared) if w)
    if is_whole(record):
        parts = [v for k, v in record.items() if not k.startswith("$")]
        return " ".join(w for v in parts for x in (v if isinstance(v, list) else [v]) for w in _deep(x))
    return " ".join(record[k] for k in searchable_keys(record))


def display_fields(fields: dict) -> dict:
    keep = lambda v: isinstance(v, (bool, int, float)) or (isinstance(v, str) and len(v) <= 200)
    return {k: v for k, v in fields.items() if not k.startswith("$") and k not in WIRING and keep(v)}


def _param(segment: str) -> bool:
    return segment.startswith(":")


def record_route(config: dict, fields: dict, slug: str) -> str | None:
    """A record's page: its filled pattern, else its own route, else the list's route and its slug."""
    pattern, route = config.get("pattern"), config.get("route")
    if pattern:
        *base, last = pattern.split("/")
        if not _param(last) or any(map(_param, base)):
            return None
        handle = fields.get(config["field"]) if config.get("field") else fields.get("$name")
        return "/".join(base) + "/" + quote(words_of(handle), safe="!'()*~") if handle not in (None, "") else None
    if fields.get("route"):
        return fields["route"]
    if not isinstance(route, str) or not route or any(map(_param, route.split("/"))):
        return None
    return re.sub(r"/$", "", route) + "/" + slug


def record_entry(record: dict, group: str, config: dict | None = None) -> dict | None:
    """id, route, title, content, excerpt, item of a record; None without a route.

    ``config``: pattern and field, or route, and search (fields, weight), as a list of records declares them.
    """
    config = config or {}
    search = config.get("search") or {}
    fields = fields_of(record)
    handle = record.get("$name") or ""
    slug = handle or words_of(fields.get("id")) or re.sub(r"\s+", "-", words_of(fields.get("title")).lower())
    route = record_route(config, fields, slug)
    if not route:
        return None
    declared = search.get("fields")
    content = record_text(record, declared if isinstance(declared, list) else None)
    about = words_of(fields.get("description")) or words_of(fields.get("excerpt")) or content
    line = re.sub(r"\s+", " ", about).strip()
    about = line if len(line) <= 160 else re.sub(r"[\s.…]+$", "", line[:160]) + "…"
    title = words_of(fields.get("title")) or words_of(fields.get("name")) or handle or slug
    weight = search.get("weight")
    return {"id": f"record:{group}:{slug}", "type": "record", "group": group, "route": route, "title": title, "content": content, "excerpt": about,
            "weight": 0.7 if weight is None else float(weight), "item": json.dumps(_plain_numbers(display_fields(fields)), ensure_ascii=False)}


_ENTRY = T.StructType([T.StructField(n, T.DoubleType() if n == "weight" else T.StringType()) for n in ("id", "type", "group", "route", "title", "content", "excerpt", "weight", "item")])


def _load(text):
    try:
        return json.loads(text) if text else None
    except ValueError:
        return None


@F.pandas_udf(T.StructType().add("title", T.StringType()).add("parts", T.ArrayType(T.StringType())))
def extract_udf(doc: pd.Series) -> pd.DataFrame:
    rows = [extract(_load(d)) for d in doc]
    return pd.DataFrame({"title": [t for t, _ in rows], "parts": [p for _, p in rows]})


@F.pandas_udf(T.StringType())
def markdown_udf(doc: pd.Series) -> pd.Series:
    return pd.Series([markdown(_load(d)) for d in doc], dtype=object)


@F.pandas_udf(T.StringType())
def record_markdown_udf(record: pd.Series) -> pd.Series:
    return pd.Series(["\n\n".join(record_blocks(_load(r))) for r in record], dtype=object)


def record_entries(records: DataFrame, group: str, config: dict | None = None, record: str = "record") -> DataFrame:
    """The columns beside ``record`` (JSON text) and the entry of each record that has a page."""

    @F.pandas_udf(_ENTRY)
    def entry(rows: pd.Series) -> pd.DataFrame:
        made = [(record_entry(r, group, config) if isinstance(r, dict) else None) or dict.fromkeys(_ENTRY.names) for r in map(_load, rows)]
        return pd.DataFrame(made, columns=_ENTRY.names)

    others = [c for c in records.columns if c != record]
    return records.select(*others, entry(record).alias("e_")).select(*others, "e_.*").where("id is not null")


@F.pandas_udf(T.StringType())
def shown_markdown_udf(name: pd.Series, value: pd.Series, again: pd.Series) -> pd.Series:
    return pd.Series(["\n\n".join(shown_blocks(n, _load(v), a)) for n, v, a in zip(name, value, again, strict=True)], dtype=object)
