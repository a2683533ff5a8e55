"""Markdown to XHTML, as far as recognised pages use it.

Blocks: headings, paragraphs, rules, fenced and indented code, quotes (as asides), lists with tasks, pipe tables, raw HTML, footnotes, link definitions.
Inline: code, emphasis, strong, strikethrough, images, links, by reference too, autolinks, hard breaks, footnote references, entities (named ones
as the characters they are: XHTML knows only XML's). Not supported: nested lists deeper than their indentation shows, emphasis that overlaps.
"""

from __future__ import annotations

import html
import re
from html.entities import html5

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

_INLINE = re.compile(r"(`+)(?P<code>.+?)\1(?!`)|!\[(?P<alt>[^\]]*)\]\((?P<src>[^)\s]+)(?:\s+\"[^\"]*\")?\)|\[\^(?P<note>[^\]]+)\]|\[(?P<text>[^\]]+)\]\((?P<href>[^)\s]+)(?:\s+\"[^\"]*\")?\)|(?P<image>!?)\[(?P<ref>[^\[\]]+)\](?:\[(?P<label>[^\[\]]*)\])?|<(?P<auto>https?://[^>\s]+)>|(?P<tag></?[A-Za-z][^<>]*>)|\*\*(?P<strong>.+?)\*\*|__(?P<strong2>.+?)__|~~(?P<gone>.+?)~~|\*(?P<em>[^*\s](?:[^*]*[^*\s])?)\*|(?<![A-Za-z0-9])_(?P<em2>[^_\s](?:[^_]*[^_\s])?)_(?![A-Za-z0-9])|\\(?P<esc>[\\`*_{}\[\]()#+\-.!|~<>])|(?P<hard>  +\n|\\\n)", re.S)
_DEFINITION = re.compile(r" {0,3}\[(?!\^)([^\[\]]+)\]:\s*<?([^\s<>]+)>?(?:\s+(?:\"[^\"]*\"|'[^']*'|\([^()]*\)))?\s*$")
_NAMED = re.compile(r"&(?!(?:amp|lt|gt|quot|apos);)([A-Za-z][A-Za-z0-9]*;)")
_ENTITY = re.compile(r"&(?!(?:#[xX][0-9a-fA-F]+|#[0-9]+|[A-Za-z0-9]+);)")
_HEAD = re.compile(r" {0,3}(#{1,6})\s+(.*?)\s*#*\s*$")
_ITEM = re.compile(r"( *)([-*+]|\d{1,9}[.)])\s+(.*)$")
_RULE = re.compile(r" {0,3}([-*_])( *\1){2,}\s*$")
_CELLS = re.compile(r"^\s*\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?\s*$")
_NOTE = re.compile(r"\[\^([^\]]+)\]:\s*(.*)$")
_RAW = re.compile(r" {0,3}</?[A-Za-z][A-Za-z0-9]*[\s/>]|^ {0,3}<!--")


def _entities(s: str) -> str:
    """Named entities as characters, and each ampersand that begins none escaped."""
    return _ENTITY.sub("&amp;", _NAMED.sub(lambda m: html5.get(m[1], f"&amp;{m[1]}"), s)) if "&" in s else s


def _label(s: str) -> str:
    return " ".join(s.lower().split())


def _plain(s: str) -> str:
    return _entities(s).replace("<", "&lt;").replace(">", "&gt;")


def inline(s: str, known: dict[str, str] | None = None) -> str:
    """known: where the labels of link definitions lead."""
    known, out, at = known or {}, [], 0
    for m in _INLINE.finditer(s):
        out.append(_plain(s[at : m.start()]))
        at = m.end()
        g = {k: v for k, v in m.groupdict().items() if v is not None}
        if "ref" in g:
            target = known.get(_label(g.get("label") or g["ref"]))
            if target is None:
                out.append(g["image"] + "[" + inline(g["ref"], known) + "]" + (f"[{inline(g['label'], known)}]" if "label" in g else ""))
            elif g["image"]:
                out.append(f'<img src="{html.escape(target)}" alt="{html.escape(g["ref"])}" />')
            else:
                out.append(f'<a href="{html.escape(target)}">{inline(g["ref"])}</a>')
        elif "code" in g:
            out.append(f"<code>{html.escape(g['code'].strip(), False)}</code>")
        elif "src" in g:
            out.append(f'<img src="{html.escape(g["src"])}" alt="{html.escape(g["alt"])}" />')
        elif "note" in g:
            out.append(f'<sup><a href="#fn-{html.escape(g["note"])}">{html.escape(g["note"])}</a></sup>')
        elif "href" in g:
            out.append(f'<a href="{html.escape(g["href"])}">{inline(g["text"])}</a>')
        elif "auto" in g:
            out.append(f'<a href="{html.escape(g["auto"])}">{html.escape(g["auto"])}</a>')
        elif "tag" in g:
            out.append(_entities(g["tag"]))
        elif "esc" in g:
            out.append(html.escape(g["esc"], False))
        elif "hard" in g:
            out.append("<br />\n")
        else:
            name = "strong" if "strong" in g or "strong2" in g else "del" if "gone" in g else "em"
            out.append(f"<{name}>{inline(next(iter(g.values())), known)}</{name}>")
    return "".join([*out, _plain(s[at:])])


def _row(line: str) -> list[str]:
    line = line.strip()
    line = line[1:] if line.startswith("|") else line
    line = line[:-1] if line.endswith("|") and not line.endswith("\\|") else line
    return [c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", line)]


def _list(lines: list[str], known: dict[str, str]) -> str:
    first = _ITEM.match(lines[0])
    base, numbered = len(first[1]), first[2][0].isdigit()
    items: list[list[str]] = []
    for line in lines:
        m = _ITEM.match(line)
        if m and len(m[1]) <= base:
            items.append([m[3]])
        else:
            items[-1].append(line[min(len(line) - len(line.lstrip()), base + 2) :])
    out = []
    for own in items:
        box = re.match(r"\[([ xX])\]\s+(.*)", own[0])
        mark = ""
        if box:
            mark = '<input type="checkbox" disabled="disabled"' + (' checked="checked"' if box[1] != " " else "") + " /> "
            own = [box[2], *own[1:]]
        inner = next((i for i, x in enumerate(own) if i and _ITEM.match(x)), len(own))
        text = inline("\n".join(x for x in own[:inner] if x.strip()), known)
        out.append(f"<li>{mark}{text}{chr(10) + _list(own[inner:], known) if inner < len(own) else ''}</li>")
    name = "ol" if numbered else "ul"
    return f"<{name}>\n" + "\n".join(out) + f"\n</{name}>"


def definitions(lines: list[str]) -> dict[str, str]:
    """Where the labels of a text's link definitions lead, the first of a label; those in fenced code are none."""
    known, fence = {}, ""
    for line in lines:
        mark = re.match(r" {0,3}(`{3,}|~{3,})", line)
        if mark:
            fence = mark[1] if not fence else "" if line.strip().startswith(fence) else fence
        elif not fence and (m := _DEFINITION.match(line)):
            known.setdefault(_label(m[1]), m[2])
    return known


def render(text: str | None, known: dict[str, str] | None = None) -> str:
    """XHTML of a markdown text; of null or blank, nothing."""
    lines = (text or "").replace("\r\n", "\n").split("\n")
    known = definitions(lines) if known is None else known
    out: list[str] = []
    notes: list[tuple[str, str]] = []
    i = 0
    while i < len(lines):
        line = lines[i]
        if not line.strip():
            i += 1
            continue
        fence = re.match(r" {0,3}(`{3,}|~{3,})", line)
        if fence:
            j = next((k for k in range(i + 1, len(lines)) if lines[k].strip().startswith(fence[1])), len(lines))
            out.append("<pre><code>" + html.escape("\n".join(lines[i + 1 : j]), False) + "</code></pre>")
            i = j + 1
        elif m := _HEAD.match(line):
            out.append(f"<h{len(m[1])}>{inline(m[2], known)}</h{len(m[1])}>")
            i += 1
        elif _RULE.match(line):
            out.append("<hr />")
            i += 1
        elif line.startswith(("    ", "\t")):
            j = i
            while j < len(lines) and (lines[j].startswith(("    ", "\t")) or not lines[j].strip()):
                j += 1
            code = [x[1:] if x.startswith("\t") else x[4:] for x in lines[i:j]]
            out.append("<pre><code>" + html.escape("\n".join(code).rstrip(), False) + "\n</code></pre>")
            i = j
        elif m := _NOTE.match(line):
            notes.append((m[1], m[2]))
            i += 1
        elif _DEFINITION.match(line):
            i += 1
        elif re.match(r" {0,3}>", line):
            j = i
            while j < len(lines) and lines[j].strip() and (j == i or re.match(r" {0,3}>", lines[j]) or not _ITEM.match(lines[j])):
                j += 1
            inner = "\n".join(re.sub(r"^ {0,3}> ?", "", x) for x in lines[i:j])
            out.append(f'<aside class="callout">\n{render(inner, known)}\n</aside>')
            i = j
        elif _ITEM.match(line):
            j = i + 1
            while j < len(lines) and (_ITEM.match(lines[j]) or (lines[j].startswith(" ") and lines[j].strip()) or (not lines[j].strip() and j + 1 < len(lines) and _ITEM.match(lines[j + 1]))):
                j += 1
            out.append(_list([x for x in lines[i:j] if x.strip()], known))
            i = j
        elif "|" in line and i + 1 < len(lines) and "-" in lines[i + 1] and _CELLS.match(lines[i + 1]) and len(_row(line)) == len(_row(lines[i + 1])):
            head, j = _row(line), i + 2
            while j < len(lines) and "|" in lines[j] and lines[j].strip():
                j += 1
            body = "".join("<tr>" + "".join(f"<td>{inline(c, known)}</td>" for c in (_row(x) + [""] * len(head))[: len(head)]) + "</tr>" for x in lines[i + 2 : j])
            out.append("<table><thead><tr>" + "".join(f"<th>{inline(c, known)}</th>" for c in head) + f"</tr></thead><tbody>{body}</tbody></table>")
            i = j
        elif _RAW.match(line):
            j = i
            while j < len(lines) and lines[j].strip():
                j += 1
            out.append(_entities("\n".join(lines[i:j])))
            i = j
        else:
            j = i + 1
            while j < len(lines) and lines[j].strip() and not re.match(r" {0,3}(=+|-+)\s*$", lines[j]) and not _HEAD.match(lines[j]) and not re.match(r" {0,3}(>|`{3}|~{3})", lines[j]):
                j += 1
            own = inline("\n".join(lines[i:j]).strip(), known)
            under = re.match(r" {0,3}(=+|-+)\s*$", lines[j]) if j < len(lines) else None
            if under:
                n = 1 if under[1][0] == "=" else 2
                out.append(f"<h{n}>{own}</h{n}>")
                i = j + 1
            else:
                out.append(f"<p>{own}</p>")
                i = j
    if notes:
        out.append('<section class="footnotes"><ol>' + "".join(f'<li id="fn-{html.escape(k)}">{inline(v, known)}</li>' for k, v in notes) + "</ol></section>")
    return "\n".join(out)


_HEADING = re.compile(r"<h([1-6])>(.*?)</h\1>", re.S)


def anchored(xhtml: str) -> str:
    """Headings without attributes get an id, numbered where it recurs."""
    seen: dict[str, int] = {}

    def one(m: re.Match) -> str:
        name = re.sub(r"[^A-Za-z0-9]+", "-", re.sub(r"<[^>]+>", "", m[2])).strip("-").lower() or "chapter"
        seen[name] = seen.get(name, 0) + 1
        return f'<h{m[1]} id="{name}{f"-{seen[name]}" if seen[name] > 1 else ""}">{m[2]}</h{m[1]}>'

    return _HEADING.sub(one, xhtml)


@F.pandas_udf(StringType())
def _rendered(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: anchored(render(x)))


def markdown_html(c: Column | str) -> Column:
    """XHTML with anchored headings. There is no built-in renderer, so texts go to Python in Arrow batches."""
    return _rendered(F.col(c) if isinstance(c, str) else c)
