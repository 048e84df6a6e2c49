"""Comments and string literals of Rust and Python source text, with their first lines."""

from __future__ import annotations

import re
from collections.abc import Iterator

# Every branch begins with a fixed character, so that the search runs over code without stopping at each word.
_RUST = re.compile(r"""//[^\n]*|/\*|"|'(?:\\(?:u\{[0-9a-fA-F_]*\}|x[0-9a-fA-F]{2}|[^\n])|[^'\\\n])'|'\w*""")
_RAW = re.compile(r"(?<!\w)[bc]?r(#*)\Z")
_RUST_BLOCK = re.compile(r"/\*|\*/")
_RUST_STR = re.compile(r'[^"\\]*(?:\\.[^"\\]*)*"', re.S)
_PYTHON = re.compile(r"""#[^\n]*|\"\"\"|\'\'\'|"|'""")
_PREFIX = re.compile(r"(?<!\w)[rRbBuUfFtT]{1,2}\Z")
_PY_END = {
    '"""': re.compile(r'(?:[^"\\]|\\.|"(?!""))*"""', re.S),
    "'''": re.compile(r"(?:[^'\\]|\\.|'(?!''))*'''", re.S),
    '"': re.compile(r'[^"\\\n]*(?:\\(?:.|\n)[^"\\\n]*)*"'),
    "'": re.compile(r"[^'\\\n]*(?:\\(?:.|\n)[^'\\\n]*)*'"),
}


def _rust(text: str) -> Iterator[tuple[int, str, str, bool]]:
    at, n = 0, len(text)
    while m := _RUST.search(text, at):
        start, at = m.span()
        head = text[start : start + 2]
        if head == "//":
            yield start, "comment", m[0][2:], True
        elif head == "/*":
            depth = 1
            while depth:
                e = _RUST_BLOCK.search(text, at)
                if not e:
                    at = n
                    break
                depth += 1 if e[0] == "/*" else -1
                at = e.end()
            yield start, "comment", text[start + 2 : at - 2 * (depth == 0)], True
        elif head[0] == '"':
            # What stands before the quote says whether the literal is raw, and how many marks close it.
            last = text[start - 1] if start else ""
            raw = _RAW.search(text, max(0, start - 300), start) if last in ("r", "#") else None
            if raw:
                end = text.find('"' + raw[1], at)
                yield start, "string", text[at : n if end < 0 else end], True
                at = n if end < 0 else end + 1 + len(raw[1])
            else:
                e = _RUST_STR.match(text, at)
                yield start, "string", text[at : e.end() - 1] if e else text[at:], False
                at = e.end() if e else n


def _python(text: str) -> Iterator[tuple[int, str, str, bool]]:
    at, n = 0, len(text)
    while m := _PYTHON.search(text, at):
        start, at = m.span()
        q = m[0]
        if q[0] == "#":
            yield start, "comment", q[1:], True
            continue
        pre = _PREFIX.search(text, max(0, start - 3), start) if start and text[start - 1].isalpha() else None
        raw = pre is not None and "r" in pre[0].lower()
        e = _PY_END[q].match(text, at)
        if e:
            yield start, "string", text[at : e.end() - len(q)], raw
            at = e.end()
        elif len(q) == 3:
            yield start, "string", text[at:], raw
            at = n
        else:  # an unclosed literal ends with its line
            stop = text.find("\n", at)
            at = n if stop < 0 else stop


_LEXERS = {"rust": _rust, "python": _python}


def units(text: str | None, code_kind: str | None) -> list[tuple[int, str, str, bool]]:
    """(line_no from 1, comment or string, body without delimiters, whether the body is raw) in order; none for unknown kinds."""
    lexer = _LEXERS.get((code_kind or "").strip().lower())
    if not text or lexer is None:
        return []
    out, line, seen = [], 1, 0
    for start, kind, body, raw in lexer(text):
        line += text.count("\n", seen, start)
        seen = start
        out.append((line, kind, body, raw))
    return out


_ESCAPE = re.compile(r"\\(?:u\{([0-9a-fA-F_]+)\}|u([0-9a-fA-F]{4})|U([0-9a-fA-F]{8})|x([0-9a-fA-F]{2})|(\r?\n[ \t]*)|(.))", re.S)


def _unescape(m: re.Match) -> str:
    code = m[1] or m[2] or m[3] or m[4]
    if code:
        v = int(code.replace("_", ""), 16)
        return chr(v) if v < 0xD800 or 0xDFFF < v < 0x110000 else " "
    if m[5]:
        return ""
    return {"n": " ", "t": " ", "r": " ", "0": " "}.get(m[6], m[6])


_MARGIN = re.compile(r"(?m)^[ \t]*(?:[/*#!|>]+(?=\s|$)|[/*#!]+)[ \t]*|[ \t\r]+$")
_TWICE = re.compile("[\u00c2-\u00f4][\u0080-\u00bf\u0152-\u2122]")


def plain(body: str, kind: str, raw: bool) -> str:
    """Readable text of a unit: escapes resolved, comment margins removed, doubly encoded letters repaired."""
    if kind == "string" and not raw:
        body = _ESCAPE.sub(_unescape, body)
    if kind == "comment":
        body = _MARGIN.sub("", body)
    if _TWICE.search(body):
        for enc in ("cp1252", "latin-1"):
            try:
                return body.encode(enc).decode("utf-8")
            except UnicodeError:
                continue
        body = _TWICE.sub(_repair, body)
    return body


def _repair(m: re.Match) -> str:
    for enc in ("cp1252", "latin-1"):
        try:
            return m[0].encode(enc).decode("utf-8")
        except UnicodeError:
            continue
    return m[0]
