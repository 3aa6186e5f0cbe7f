"""The macro layer: text in, steps of text out, on the driver.

Expansion is lazy: a step is handed out as soon as it is complete, so what it puts into
macro variables is there when the text after it is expanded."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

from statloom.formats import UnsupportedFeature, best, put, to_number
from statloom.functions.handles import NAMES as HANDLE_NAMES
from statloom.plans.lexer import ProgramError

#: Marks that stand for masked characters while text is quoted.
_MASKED = {c: chr(0xE000 + k) for k, c in enumerate("&%;,'\"()=+-*/<>^~|# ")}
_UNMASK = {v: k for k, v in _MASKED.items()}


def mask(s: str, chars: str) -> str:
    return "".join(_MASKED[c] if c in chars else c for c in s)


def unmask(s: str) -> str:
    return "".join(_UNMASK.get(c, c) for c in s)


class _Return(Exception):
    pass


class _Goto(Exception):
    def __init__(self, label: str):
        self.label = label


class Scopes(dict):
    """The global variables; local ones in a stack over them."""

    def __init__(self):
        super().__init__()
        self.stack: list[dict[str, str]] = []

    def find(self, name: str) -> dict | None:
        key = name.lower()
        for d in reversed(self.stack):
            if key in d:
                return d
        return self if key in self else None

    def get(self, name, default=None):
        d = self.find(name)
        return dict.get(d, name.lower(), default) if d is not None else default

    def assign(self, name: str, value: str) -> None:
        key = name.lower()
        d = self.find(key)
        (d if d is not None else self.stack[-1] if self.stack else self)[key] = value

    def __contains__(self, name):
        return dict.__contains__(self, name.lower()) or any(name.lower() in d for d in getattr(self, "stack", ()))


class Macro:
    def __init__(self, session):
        self.session = session
        self.vars = Scopes()
        self.macros: dict[str, tuple[list[tuple[str, str | None]], str, str]] = {}
        self.autocall: list[str] = []
        for k, v in {"sysver": "9.4", "sysscp": "LIN X64", "syscc": "0", "sysrc": "0", "syserr": "0", "sqlrc": "0", "sqlobs": "0", "sysparm": "", "sysdate9": "01JAN2024", "sysdate": "01JAN24", "systime": "00:00", "sysday": "Monday", "sysuserid": "user", "sysmacroname": "", "syslast": "_NULL_"}.items():
            self.vars[k] = v
        self.put: list[str] = []

    # -- steps

    def steps(self, text: str) -> Iterator[str]:
        """Step texts: DATA and PROC steps up to RUN, QUIT or the next step, and global
        statements one by one."""
        buffer, inside = "", ""
        for piece in self.expand(text):
            buffer += piece
            while True:
                cut = self._cut(buffer, inside)
                if cut is None:
                    break
                step, buffer, inside = cut
                if step.strip().strip(";").strip():
                    yield unmask(step)
        if buffer.strip().strip(";").strip():
            yield unmask(buffer)

    _START = re.compile(r"\s*(data|proc)\b", re.I)
    _END = re.compile(r"\s*(run|quit)\s*(cancel)?\s*;", re.I)

    def _cut(self, buffer: str, inside: str):
        """(a step, the rest, "") if the buffer has a whole one."""
        at, first = 0, True
        text = buffer
        lead = re.match(r"(\s|/\*.*?\*/|;)*", text, re.S).end()
        at = lead
        m = self._START.match(text, at)
        if not m:
            end = _semicolon(text, at)
            if end is None:
                return None
            return text[at : end + 1], text[end + 1 :], ""
        sql = re.match(r"\s*proc\s+(sql|datasets)\b", text[at:], re.I)
        pos = _semicolon(text, at)
        if pos is None:
            return None
        while True:
            pos += 1
            if re.match(r"\s*(datalines|cards)4?\s*;", text[pos:], re.I):
                m = re.search(r"\n[^\n]*;", text[_semicolon(text, pos) + 1 :])
                if not m:
                    return None
                pos = _semicolon(text, pos) + 1 + m.end() - 1
                continue
            if e := self._END.match(text, pos):
                if sql and e[1].lower() == "run":
                    pos = _semicolon(text, pos)
                    continue
                return text[at : pos], text[pos + e.end() - pos :], ""
            nxt = self._START.match(text, pos)
            word = re.match(r"\s*(\w+)\s*([^;]*)", text[pos:])
            if nxt and not (word and word[1].lower() == "data" and word[2].lstrip()[:1] == "="):
                return text[at:pos], text[pos:], ""
            end = _semicolon(text, pos)
            if end is None:
                return None
            pos = end
            first = False
        return first

    # -- expansion

    def expand(self, text: str, top: bool = True) -> Iterator[str]:
        at, n = 0, len(text)
        while at < n:
            m = re.compile(r"/\*|'|\"|%|&|;").search(text, at)
            if not m:
                yield text[at:]
                return
            if m.start() > at:
                yield text[at : m.start()]
            at = m.start()
            c = m[0]
            if c == "/*":
                end = text.find("*/", at + 2)
                at = n if end < 0 else end + 2
            elif c == "'":
                end = text.find("'", at + 1)
                end = n - 1 if end < 0 else end
                yield text[at : end + 1]
                at = end + 1
            elif c == '"':
                end = text.find('"', at + 1)
                end = n - 1 if end < 0 else end
                yield '"' + unmask(self.resolve(text[at + 1 : end])) + '"'
                at = end + 1
            elif c == ";":
                yield ";"
                at += 1
            elif c == "&":
                s, at = self.reference(text, at)
                yield s
            else:
                for piece, at in self.percent(text, at):
                    if piece:
                        yield piece

    def resolve(self, text: str) -> str:
        """All of a text, at once."""
        return "".join(self.expand(text, False))

    def reference(self, text: str, at: int) -> tuple[str, int]:
        """&name., &&name and so on: the value, and where the text goes on."""
        m = re.compile(r"(&+)([A-Za-z_]\w*)?(\.?)").match(text, at)
        if not m[2]:
            return m[1], m.start() + len(m[1])
        if len(m[1]) == 1:
            value = self.vars.get(m[2])
            if value is None:
                return f"&{m[2]}{m[3]}", m.end()
            return str(value), m.end()
        # Pairs of ampersands become one; then the text is scanned again.
        end = at
        while (k := re.compile(r"&+[A-Za-z_]\w*\.?|&+|[A-Za-z_0-9]+\.?").match(text, end)) and (end == at or text[end] == "&" or text[end].isalnum() or text[end] == "_"):
            end = k.end()
        raw = text[at:end]
        for _ in range(20):
            nxt = re.sub(r"&&|&([A-Za-z_]\w*)\.?", lambda q: "&" if q[0] == "&&" else str(self.vars.get(q[1], q[0])), raw)
            if nxt == raw or "&" not in nxt:
                return nxt, end
            raw = nxt
        return raw, end

    # -- macro statements and functions

    def percent(self, text: str, at: int) -> Iterator[tuple[str, int]]:
        m = re.compile(r"%([A-Za-z_]\w*)").match(text, at)
        if not m:
            if text[at : at + 2] == "%*":
                end = _semicolon(text, at)
                yield "", len(text) if end is None else end + 1
                return
            yield "%", at + 1
            return
        name, after = m[1].lower(), m.end()
        handler = getattr(self, f"do_{name}", None)
        if handler:
            yield from handler(text, after)
            return
        if name in FUNCTIONS:
            arg, end = _parenthesised(text, after)
            yield FUNCTIONS[name](self, arg if arg is not None else ""), end
            return
        if name in self.macros or self._autoload(name):
            yield from self.call(name, text, after)
            return
        yield m[0], after

    def _statement(self, text: str, at: int) -> tuple[str, int]:
        end = _semicolon(text, at)
        end = len(text) if end is None else end
        return text[at:end], end + 1

    def do_let(self, text, at):
        s, end = self._statement(text, at)
        name, _, value = s.partition("=")
        self.vars.assign(self.resolve(name).strip(), self.resolve(value).strip())
        yield "", end

    def do_put(self, text, at):
        s, end = self._statement(text, at)
        line = unmask(self.resolve(s)).strip()
        self.put.append(line)
        self.session.log.append(line) if self.session else None
        yield "", end

    def do_global(self, text, at):
        s, end = self._statement(text, at)
        for name in self.resolve(s).split():
            if not dict.__contains__(self.vars, name.lower()):
                self.vars[name.lower()] = ""
        yield "", end

    def do_local(self, text, at):
        s, end = self._statement(text, at)
        for name in self.resolve(s).split():
            if self.vars.stack:
                self.vars.stack[-1].setdefault(name.lower(), "")
        yield "", end

    def do_symdel(self, text, at):
        s, end = self._statement(text, at)
        for name in self.resolve(s).split("/")[0].split():
            dict.pop(self.vars, name.lower(), None)
        yield "", end

    def do_return(self, text, at):
        raise _Return

    def do_abort(self, text, at):
        raise ProgramError("%ABORT")

    def do_goto(self, text, at):
        s, _ = self._statement(text, at)
        raise _Goto(self.resolve(s).strip().lower())

    def do_sysexec(self, text, at):
        raise UnsupportedFeature("%SYSEXEC")

    do_window = do_display = do_sysexec

    def do_include(self, text, at):
        s, end = self._statement(text, at)
        path = unmask(self.resolve(s)).strip().split("/source2")[0].strip().strip("'\"")
        path = self.session.files.get(path.lower(), path)
        with open(path, encoding="utf-8") as f:
            body = f.read()
        for piece in self.expand(body):
            yield piece, end
        yield "", end

    do_inc = do_include

    def do_syscall(self, text, at):
        s, end = self._statement(text, at)
        m = re.match(r"\s*(\w+)\s*\((.*)\)", s, re.S)
        if m[1].lower() in ("symputx", "symput"):
            a, b = _arguments(m[2])
            self.vars.assign(self.vars.get(a.strip(), a.strip()), str(self.vars.get(b.strip(), b.strip())))
        else:
            raise UnsupportedFeature(f"%SYSCALL {m[1]}")
        yield "", end

    def do_macro(self, text, at):
        m = re.compile(r"\s*([A-Za-z_]\w*)\s*").match(text, at)
        name = m[1].lower()
        params: list[tuple[str, str | None]] = []
        end = m.end()
        if text[end : end + 1] == "(":
            arg, end = _parenthesised(text, end)
            for a in _arguments(arg):
                key, eq, default = a.partition("=")
                if key.strip():
                    params.append((key.strip().lower(), default.strip() if eq else None))
        opts, body_at = self._statement(text, end)
        depth, pos = 1, body_at
        for k in re.compile(r"/\*.*?\*/|%(macro|mend)\b", re.I | re.S).finditer(text, body_at):
            if not k[1]:
                continue
            depth += 1 if k[1].lower() == "macro" else -1
            if not depth:
                pos = k.start()
                end = _semicolon(text, k.end())
                self.macros[name] = (params, text[body_at:pos], opts.lower())
                yield "", (len(text) if end is None else end + 1)
                return
        raise ProgramError(f"%MACRO {name} without %MEND")

    def _autoload(self, name: str) -> bool:
        for folder in self.autocall:
            path = os.path.join(folder, f"{name}.sas")
            if os.path.exists(path):
                with open(path, encoding="utf-8") as f:
                    self.resolve(f.read())
                return name in self.macros
        return False

    def call(self, name: str, text: str, at: int):
        params, body, opts = self.macros[name]
        end, given = at, []
        m = re.compile(r"\s*\(").match(text, at)
        if m:
            arg, end = _parenthesised(text, m.end() - 1)
            given = _arguments(arg)
        scope: dict[str, str] = {p: "" if d is None else self.resolve(d) for p, d in params}
        names = [p for p, d in params]
        k = 0
        for a in given:
            key, eq, value = a.partition("=")
            if eq and key.strip().lower() in names:
                scope[key.strip().lower()] = self.resolve(value).strip()
            elif a.strip() or k < len(names):
                if k < len(names):
                    scope[names[k]] = self.resolve(a).strip()
                elif params:
                    raise ProgramError(f"too many arguments of %{name}")
                k += 1
        scope["syspbuff"] = "(" + ",".join(given) + ")" if given else ""
        self.vars.stack.append(scope)
        try:
            start = 0
            while True:
                try:
                    for piece in self.expand(body[start:]):
                        yield piece, end
                    break
                except _Goto as g:
                    m = re.search(rf"%{g.label}\s*:", body, re.I)
                    if not m:
                        raise ProgramError(f"no label %{g.label}") from None
                    start = m.end()
        except _Return:
            pass
        finally:
            self.vars.stack.remove(scope)
        yield "", end

    def do_if(self, text, at):
        k = _find_word(text, at, "%then")
        if k is None:
            raise ProgramError("%IF without %THEN")
        cond = truth(self.evaluate(text[at:k]))
        body, end = self._clause(text, k + 5)
        m = re.compile(r"\s*(?:/\*.*?\*/\s*)*%else\b", re.I | re.S).match(text, end)
        other = None
        if m:
            other, end = self._clause(text, m.end())
        chosen = body if cond else other
        if chosen is not None:
            for piece in self.expand(chosen):
                yield piece, end
        yield "", end

    def _clause(self, text: str, at: int) -> tuple[str, int]:
        """A %DO group or a statement, as text."""
        m = re.compile(r"\s*").match(text, at)
        at = m.end()
        if re.compile(r"%do\b", re.I).match(text, at):
            end = _block_end(text, at + 3)
            return text[at : end], end
        if re.compile(r"%if\b", re.I).match(text, at):
            k = _find_word(text, at + 3, "%then")
            _, end = self._clause(text, k + 5)
            m = re.compile(r"\s*%else\b", re.I).match(text, end)
            if m:
                _, end = self._clause(text, m.end())
            return text[at:end], end
        end = _semicolon(text, at)
        end = len(text) if end is None else end + 1
        clause = text[at:end]
        # The semicolon of a macro statement is its own; of plain text it belongs to %IF.
        return (clause if clause.lstrip().startswith("%") and re.match(r"\s*%(let|put|global|local|return|goto|abort|include|inc|symdel|syscall)\b", clause, re.I) else clause[:-1] if clause.endswith(";") else clause), end

    def do_do(self, text, at):
        end = _block_end(text, at)
        head_end = _semicolon(text, at)
        head = text[at:head_end]
        inner = text[head_end + 1 : end]
        inner = inner[: re.compile(r"%end\s*;?\s*$", re.I).search(inner).start()]
        if not head.strip():
            for piece in self.expand(inner):
                yield piece, end
        elif m := re.match(r"\s*%?(while|until)\s*\((.*)\)\s*$", head, re.I | re.S):
            for k in range(1_000_000):
                if m[1].lower() == "while" and not truth(self.evaluate(m[2])):
                    break
                for piece in self.expand(inner):
                    yield piece, end
                if m[1].lower() == "until" and truth(self.evaluate(m[2])):
                    break
        else:
            var, _, spec = head.partition("=")
            k = _find_word(spec, 0, "%to")
            j = _find_word(spec, k, "%by")
            first, last = int(self.evaluate(spec[:k])), int(self.evaluate(spec[k + 3 : j] if j is not None else spec[k + 3 :]))
            step = int(self.evaluate(spec[j + 3 :])) if j is not None else 1
            name = self.resolve(var).strip()
            i = first
            while i <= last if step > 0 else i >= last:
                self.vars.assign(name, str(i))
                for piece in self.expand(inner):
                    yield piece, end
                i = int(self.vars.get(name)) + step
            self.vars.assign(name, str(i))
        yield "", end

    def do_end(self, text, at):
        raise ProgramError("%END without %DO")

    def do_then(self, text, at):
        raise ProgramError("%THEN without %IF")

    def do_mend(self, text, at):
        raise ProgramError("%MEND without %MACRO")

    def evaluate(self, text: str, floating: bool = False) -> str:
        """%EVAL or %SYSEVALF of a text."""
        return _Eval(unmask_later(self.resolve(text)), floating).value()


def unmask_later(s: str) -> str:
    return s


class _Eval:
    """Integer (or floating) arithmetic, comparisons of numbers or text, and logic."""

    TOKEN = re.compile(r"\s*(\*\*|<=|>=|\^=|~=|<>|><|[-+*/()=<>&|^~#]|[^\s\-+*/()=<>&|^~#]+)")
    WORDS = {"and": "&", "or": "|", "not": "^", "eq": "=", "ne": "^=", "lt": "<", "le": "<=", "gt": ">", "ge": ">=", "in": "in"}

    def __init__(self, text: str, floating: bool):
        self.t = [self.WORDS.get(m[1].lower(), m[1]) for m in self.TOKEN.finditer(text)]
        self.k, self.floating = 0, floating

    def peek(self):
        return self.t[self.k] if self.k < len(self.t) else None

    def take(self):
        self.k += 1
        return self.t[self.k - 1]

    def value(self) -> str:
        if not self.t:
            return "0" if not self.floating else "."
        out = self.level(0)
        if self.peek() is not None:
            raise ProgramError(f"cannot evaluate {' '.join(self.t)}")
        return out

    LEVELS = (("|",), ("&",), ("=", "^=", "~=", "<", "<=", ">", ">=", "in", "#"), ("+", "-"), ("*", "/"), ("**",))

    def level(self, n: int) -> str:
        if n == len(self.LEVELS):
            return self.unary()
        if n == 2 and self.peek() in ("^", "~"):
            self.take()
            return str(int(not truth(self.level(2))))
        left = self.level(n + 1)
        while (op := self.peek()) in self.LEVELS[n]:
            self.take()
            if op in ("in", "#"):
                items = [self.level(3)] if self.peek() != "(" else self._items()
                left = str(int(left in items))
                continue
            left = self.apply(op, left, self.level(n + 1))
        if n == 3 and self.peek() is not None and self.peek() not in "|&=)" and not any(self.peek() in lv for lv in self.LEVELS):
            # Words side by side are one text.
            while self.peek() is not None and self.peek() not in (")", "(") and not any(self.peek() in lv for lv in self.LEVELS):
                left += " " + self.take()
        return left

    def _items(self):
        self.take()
        out = []
        while (x := self.take()) != ")":
            out += [v for v in x.split(",") if v]
        return out

    def unary(self) -> str:
        p = self.peek()
        if p in ("-", "+"):
            self.take()
            x = self.unary()
            return x if p == "+" else self._text(-self._number(x))
        if p in ("^", "~"):
            self.take()
            return str(int(not truth(self.unary())))
        if p == "(":
            self.take()
            x = self.level(0)
            if self.peek() == ")":
                self.take()
            return x
        if p is None or p == ")" or any(p in lv for lv in self.LEVELS):
            return ""
        return unmask(self.take())

    def _number(self, s: str):
        x = to_number(s)
        if x is None:
            raise ProgramError(f"a number is needed, not {s!r}")
        if not self.floating and x != int(x):
            raise ProgramError(f"a whole number is needed, not {s}")
        return x if self.floating else int(x)

    def _text(self, x) -> str:
        return str(int(x)) if float(x) == int(x) else best(float(x), 16).strip()

    def apply(self, op: str, a: str, b: str) -> str:
        if op == "|":
            return str(int(truth(a) or truth(b)))
        if op == "&":
            return str(int(truth(a) and truth(b)))
        if op in ("=", "^=", "~=", "<", "<=", ">", ">="):
            x, y = to_number(a), to_number(b)
            if x is None or y is None or not self.floating and (x != int(x) or y != int(y)):
                x, y = a.strip(), b.strip()
            return str(int({"=": x == y, "^=": x != y, "~=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]))
        x, y = self._number(a), self._number(b)
        if op == "/":
            if y == 0:
                raise ProgramError("division by zero")
            return self._text(x / y if self.floating else int(x / y))
        return self._text({"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "**": lambda: x**y}[op]())


def truth(s: str) -> bool:
    x = to_number(str(s))
    if x is None:
        raise ProgramError(f"a condition is needed, not {s!r}")
    return x != 0


def _semicolon(text: str, at: int) -> int | None:
    """The next semicolon outside quotes, comments and parentheses of macro functions."""
    quote, k = "", at
    while k < len(text):
        c = text[k]
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif text.startswith("/*", k):
            e = text.find("*/", k + 2)
            k = len(text) if e < 0 else e + 1
        elif c == "%" and (m := re.compile(r"%(nr)?str\s*\(|%b?quote\s*\(", re.I).match(text, k)):
            _, k = _parenthesised(text, m.end() - 1)
            continue
        elif c == ";":
            return k
        k += 1
    return None


def _parenthesised(text: str, at: int) -> tuple[str | None, int]:
    m = re.compile(r"\s*\(").match(text, at)
    if not m:
        return None, at
    depth, quote, k = 0, "", m.end() - 1
    while k < len(text):
        c = text[k]
        if quote:
            quote = "" if c == quote else quote
        elif c == "%" and text[k + 1 : k + 2] in ("'", '"', "(", ")", "%"):
            k += 1
        elif c in "'\"":
            quote = c
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
            if not depth:
                return text[m.end() : k], k + 1
        k += 1
    raise ProgramError("unclosed parenthesis")


def _arguments(text: str) -> list[str]:
    out, depth, quote, at = [], 0, "", 0
    for k, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
        elif c == "," and not depth:
            out.append(text[at:k])
            at = k + 1
    return out + [text[at:]]


def _find_word(text: str, at: int, word: str) -> int | None:
    m = re.compile(re.escape(word) + r"\b", re.I).search(text, at)
    return m.start() if m else None


def _block_end(text: str, at: int) -> int:
    """After the %END; of the %DO whose text begins at ``at``."""
    depth = 1
    for m in re.compile(r"/\*.*?\*/|'[^']*'|\"[^\"]*\"|%(do|end)\b", re.I | re.S).finditer(text, at):
        if not m[1]:
            continue
        depth += 1 if m[1].lower() == "do" else -1
        if not depth:
            tail = re.compile(r"\s*;").match(text, m.end())
            return tail.end() if tail else m.end()
    raise ProgramError("%DO without %END")


# ---- functions ----------------------------------------------------------------------------


def _resolved(f):
    return lambda m, arg: f(*[m.resolve(a).strip() for a in _arguments(arg)])


def _scan(s, n, delims=None, mods=""):
    from statloom.functions.chars import scan

    return scan(unmask(s), float(n), unmask(delims) if delims else None, mods)


def _int(m, s):
    return int(m.evaluate(s))


def _substr(m, arg):
    a = _arguments(arg)
    s, p = m.resolve(a[0]).strip(), _int(m, a[1])
    return s[p - 1 :] if len(a) < 3 else s[p - 1 : p - 1 + _int(m, a[2])]


def _sysfunc(m, arg):
    """%SYSFUNC(function(arguments)[, format])."""
    from statloom.functions import catalog as fn

    parts = _arguments(arg)
    call, fmt = parts[0], (parts[1] if len(parts) > 1 else "")
    k = re.match(r"\s*(\w+)\s*\((.*)\)\s*$", m.resolve(call), re.S)
    name = k[1].upper()
    raw = [unmask(a).strip() for a in _arguments(k[2])] if k[2].strip() else []
    session = m.session
    if name in ("PUTN", "PUTC"):
        return put(to_number(raw[0]) if name == "PUTN" else raw[0], raw[1], session.formats).strip()
    elif name in ("INPUTN", "INPUTC"):
        x = fn.call(name, raw[0], raw[1])
    elif name in HANDLE_NAMES:
        x = session.handles.call(name, [v if to_number(v) is None else to_number(v) for v in raw])
    elif name == "SYSFUNC":
        raise ProgramError("nested %SYSFUNC")
    else:
        if name not in fn.KERNELS:
            raise UnsupportedFeature(f"function {name}")
        typed = [v if to_number(v) is None or name in fn_text else to_number(v) for v in raw]
        x = fn.call(name, *typed)
    if fmt.strip():
        return put(x, m.resolve(fmt).strip(), session.formats if session else None).strip()
    return x if isinstance(x, str) else best(x, 12).strip()


fn_text = {"UPCASE", "LOWCASE", "STRIP", "TRIM", "COMPRESS", "SCAN_", "LEFT"}


FUNCTIONS = {
    "eval": lambda m, a: m.evaluate(a),
    "sysevalf": lambda m, a: _sysevalf(m, a),
    "str": lambda m, a: mask(m.resolve(_percents(a)), ";,'\"()=+-*/<>^~|# "),
    "nrstr": lambda m, a: mask(_percents(a), "&%;,'\"()=+-*/<>^~|# "),
    "quote": lambda m, a: mask(m.resolve(a), ";,'\"()=+-*/<>^~|# "),
    "bquote": lambda m, a: mask(m.resolve(a), ";,'\"()=+-*/<>^~|# "),
    "nrquote": lambda m, a: mask(m.resolve(a), "&%;,'\"()=+-*/<>^~|# "),
    "nrbquote": lambda m, a: mask(m.resolve(a), "&%;,'\"()=+-*/<>^~|# "),
    "superq": lambda m, a: mask(str(m.vars.get(m.resolve(a).strip(), "")), "&%;,'\"()=+-*/<>^~|# "),
    "unquote": lambda m, a: m.resolve(unmask(m.resolve(a))),
    "upcase": lambda m, a: m.resolve(a).upper(),
    "qupcase": lambda m, a: m.resolve(a).upper(),
    "lowcase": lambda m, a: m.resolve(a).lower(),
    "qlowcase": lambda m, a: m.resolve(a).lower(),
    "left": lambda m, a: m.resolve(a).lstrip(),
    "qleft": lambda m, a: m.resolve(a).lstrip(),
    "trim": lambda m, a: m.resolve(a).rstrip(),
    "qtrim": lambda m, a: m.resolve(a).rstrip(),
    "cmpres": lambda m, a: " ".join(m.resolve(a).split()),
    "qcmpres": lambda m, a: " ".join(m.resolve(a).split()),
    "scan": _resolved(_scan),
    "qscan": _resolved(_scan),
    "substr": _substr,
    "qsubstr": _substr,
    "index": _resolved(lambda s, t: str(unmask(s).find(unmask(t)) + 1)),
    "length": lambda m, a: str(len(unmask(m.resolve(a)).strip()) or 0),
    "verify": _resolved(lambda s, t: str(next((k + 1 for k, c in enumerate(unmask(s)) if c not in unmask(t)), 0))),
    "datatyp": lambda m, a: "NUMERIC" if to_number(m.resolve(a)) is not None else "CHAR",
    "sysfunc": _sysfunc,
    "qsysfunc": _sysfunc,
    "symexist": lambda m, a: str(int(m.resolve(a).strip() in m.vars)),
    "symglobl": lambda m, a: str(int(dict.__contains__(m.vars, m.resolve(a).strip().lower()))),
    "symlocal": lambda m, a: str(int(any(m.resolve(a).strip().lower() in d for d in m.vars.stack))),
    "sysmacexist": lambda m, a: str(int(m.resolve(a).strip().lower() in m.macros)),
    "sysget": lambda m, a: os.environ.get(m.resolve(a).strip(), ""),
    "sysrc": lambda m, a: "0",
}


def _percents(s: str) -> str:
    return re.sub(r"%(['\"()%])", r"\1", s)


def _sysevalf(m, a):
    parts = _arguments(a)
    x = m.evaluate(parts[0], True)
    kind = parts[1].strip().lower() if len(parts) > 1 else ""
    v = to_number(x)
    if kind == "boolean":
        return str(int(bool(v)))
    if kind in ("ceil", "floor", "integer") and v is not None:
        import math

        return str({"ceil": math.ceil, "floor": math.floor, "integer": math.trunc}[kind](v))
    return x
