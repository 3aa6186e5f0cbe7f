"""Perl regular expressions: /pattern/flags and s/pattern/replacement/flags."""

from __future__ import annotations

import functools
import re

from statloom.functions.chars import text

_PAIRS = {"(": ")", "[": "]", "{": "}", "<": ">"}
#: Patterns by number, as PRXPARSE gives them out.
_numbered: list[str] = []


@functools.lru_cache(maxsize=4096)
def parse(spec: str) -> tuple[re.Pattern, str | None]:
    """(pattern, replacement or None)."""
    s = spec.strip()
    sub = s[:1] == "s" and len(s) > 1 and not s[1].isalnum()
    body = s[1:] if sub else s[1:] if s[:1] == "m" and len(s) > 1 and not s[1].isalnum() else s
    if not body:
        raise ValueError("empty pattern")
    open_, close = body[0], _PAIRS.get(body[0], body[0])

    def upto(at: int) -> int:
        depth = 0
        while at < len(body):
            c = body[at]
            if c == "\\":
                at += 1
            elif c == close and not depth:
                return at
            elif c == open_ and open_ != close:
                depth += 1
            elif c == close:
                depth -= 1
            at += 1
        raise ValueError(f"unended pattern {spec}")

    end = upto(1)
    pattern, rest, repl = body[1:end], body[end + 1 :], None
    if sub:
        if open_ != close:
            rest = rest.lstrip()
            body, end = rest, 0
            end = upto(1)
            repl, rest = body[1:end], body[end + 1 :]
        else:
            stop = upto(end + 1)
            repl, rest = body[end + 1 : stop], body[stop + 1 :]
    flags = 0
    for f in rest.strip():
        flags |= {"i": re.I, "m": re.M, "s": re.S, "x": re.X}.get(f, 0)
    return re.compile(pattern.replace("\\/", "/").replace(r"\z", r"\Z"), flags | re.A), repl


def of(p) -> tuple[re.Pattern, str | None]:
    """A pattern given by number or by its text."""
    return parse(_numbered[int(p) - 1] if isinstance(p, float) else text(p))


def prxparse(spec):
    try:
        parse(text(spec))
    except (ValueError, re.error):
        return None
    if text(spec) not in _numbered:
        _numbered.append(text(spec))
    return float(_numbered.index(text(spec)) + 1)


def expand(repl: str, m: re.Match) -> str:
    r"""Perl's $1, ${1}, \1, $& and the case escapes \U \L \E \u \l."""
    out, mode, once = [], "", ""
    for t in re.finditer(r"\\([ULEul])|\\(\d)|\$\{?(\d+)\}?|\$&|\\(.)|.", repl, re.S):
        if t[1]:
            if t[1] in "UL":
                mode = t[1]
            elif t[1] == "E":
                mode = ""
            else:
                once = t[1]
            continue
        k = t[2] or t[3]
        s = (m[int(k)] or "") if k and int(k) <= (m.re.groups or 0) else "" if k else m[0] if t[0] == "$&" else {"n": "\n", "t": "\t"}.get(t[4], t[4]) if t[4] else t[0]
        if once and s:
            s = (s[0].upper() if once == "u" else s[0].lower()) + s[1:]
            once = ""
        out.append(s.upper() if mode == "U" else s.lower() if mode == "L" else s)
    return "".join(out)


def prxmatch(p, s):
    m = of(p)[0].search(text(s))
    return float(m.start() + 1) if m else 0.0


def prxchange(p, times, s):
    pattern, repl = of(p)
    if repl is None:
        return text(s)
    n = int(times)
    return pattern.sub(lambda m: expand(repl, m), text(s), count=0 if n < 0 else n) if n else text(s)


def prxposn(p, k, s):
    m = of(p)[0].search(text(s))
    k = int(k or 0)
    return (m[k] or "") if m and k <= m.re.groups else ""


def prxparen(p, s=""):
    m = of(p)[0].search(text(s))
    return float(max((k for k in range(1, m.re.groups + 1) if m[k] is not None), default=0)) if m else 0.0


def prxsubstr(p, s):
    """(position, length) of the first match, (0, 0) without."""
    m = of(p)[0].search(text(s))
    return (float(m.start() + 1), float(m.end() - m.start())) if m else (0.0, 0.0)


def prxnext(p, start, stop, s):
    """(new start, position, length) of the next match from start."""
    s = text(s)
    stop = len(s) if stop is None or stop < 0 else int(stop)
    m = of(p)[0].search(s, int(start) - 1, stop)
    if not m:
        return float(start), 0.0, 0.0
    return float(m.end() + 1 + (m.end() == m.start())), float(m.start() + 1), float(m.end() - m.start())


KERNELS = {
    "PRXPARSE": (prxparse, "n"),
    "PRXMATCH": (prxmatch, "n"),
    "PRXCHANGE": (prxchange, "c"),
    "PRXPOSN": (prxposn, "c"),
    "PRXPAREN": (prxparen, "n"),
}
