"""Functions on opened datasets, variable attributes, macro variables and digest streams.

They need a session, so they run where it is: in steps that run on the driver and in
%SYSFUNC."""

from __future__ import annotations

import hashlib
import hmac
import re

from statloom.formats import split_spec
from statloom.functions.chars import text
from statloom.operators.order import RID, row_numbers


class Handles:
    """Opened datasets by number. FETCH goes forward through the rows as they arrive;
    FETCHOBS finds a row by number on the cluster."""

    def __init__(self, session):
        self.s, self.open_, self.last, self.streams, self.message = session, {}, 0, {}, ""

    def call(self, name: str, args: list):
        return getattr(self, "fn_" + name.lower())(*args)

    def _of(self, dsid):
        h = self.open_.get(float(dsid or 0))
        if h is None:
            raise ValueError(f"dataset id {dsid} is not open")
        return h

    def fn_exist(self, name, *a):
        return float(self.s.exists(text(name).strip()))

    def fn_open(self, name, mode="I"):
        name = text(name).strip()
        if not self.s.exists(name):
            self.message = f"{name} does not exist"
            return 0.0
        self.last += 1
        df = self.s.rows(name)
        self.open_[float(self.last)] = {"name": name, "df": df, "it": None, "row": None, "at": 0, "notes": {}}
        return float(self.last)

    def fn_close(self, dsid):
        self.open_.pop(float(dsid), None)
        return 0.0

    def fn_dsname(self, dsid):
        name = self._of(dsid)["name"].upper()
        return name if "." in name else "WORK." + name

    def fn_nobs(self, dsid):
        return float(self._of(dsid)["df"].count())

    def fn_attrn(self, dsid, what):
        h, w = self._of(dsid), text(what).strip().upper()
        if w in ("NOBS", "NLOBS", "NLOBSF"):
            return float(h["df"].count())
        return {"NVARS": float(len(h["df"].columns)), "ANY": 1.0, "ISINDEX": 0.0, "RANDOM": 1.0}.get(w)

    def fn_attrc(self, dsid, what):
        h, w = self._of(dsid), text(what).strip().upper()
        return {"MEM": h["name"].rpartition(".")[2].upper(), "LIB": (h["name"].rpartition(".")[0] or "WORK").upper(), "MTYPE": "DATA", "ENGINE": "SPARK"}.get(w, "")

    def fn_fetch(self, dsid, *a):
        h = self._of(dsid)
        if h["it"] is None:
            h["it"] = h["df"].toLocalIterator()
        h["row"] = next(h["it"], None)
        if h["row"] is None:
            return -1.0
        h["at"] += 1
        return 0.0

    def fn_fetchobs(self, dsid, n, *a):
        h = self._of(dsid)
        df = self.s.table(h["name"])
        got = row_numbers(df, [RID]).where(f"__n = {int(n)}").drop("__n", RID).limit(1).collect() if RID in df.columns else []
        if not got:
            return -1.0
        h["row"], h["at"] = got[0], int(n)
        return 0.0

    def fn_curobs(self, dsid):
        return float(self._of(dsid)["at"])

    def fn_rewind(self, dsid):
        self._of(dsid).update(it=None, row=None, at=0)
        return 0.0

    def fn_note(self, dsid):
        h = self._of(dsid)
        h["notes"][float(len(h["notes"]) + 1)] = h["at"]
        return float(len(h["notes"]))

    def fn_point(self, dsid, note):
        return self.fn_fetchobs(dsid, self._of(dsid)["notes"][float(note)])

    def fn_dropnote(self, dsid, note):
        self._of(dsid)["notes"].pop(float(note), None)
        return 0.0

    def _value(self, dsid, n):
        h = self._of(dsid)
        return h["row"][int(n) - 1] if h["row"] is not None else None

    def fn_getvarn(self, dsid, n):
        v = self._value(dsid, n)
        return None if v is None or isinstance(v, str) else float(v)

    def fn_getvarc(self, dsid, n):
        return text(self._value(dsid, n))

    def _field(self, dsid, n):
        return self._of(dsid)["df"].schema[int(n) - 1]

    def fn_varname(self, dsid, n):
        return self._field(dsid, n).name

    def fn_varnum(self, dsid, name):
        low = [c.lower() for c in self._of(dsid)["df"].columns]
        return float(low.index(text(name).strip().lower()) + 1) if text(name).strip().lower() in low else 0.0

    def fn_vartype(self, dsid, n):
        return "C" if self._field(dsid, n).dataType.typeName() == "string" else "N"

    def fn_varlen(self, dsid, n):
        f = self._field(dsid, n)
        return float((f.metadata or {}).get("len", 8))

    def fn_varlabel(self, dsid, n):
        return (self._field(dsid, n).metadata or {}).get("label", "")

    def fn_varfmt(self, dsid, n):
        return (self._field(dsid, n).metadata or {}).get("format", "")

    def fn_varinfmt(self, dsid, n):
        return (self._field(dsid, n).metadata or {}).get("informat", "")

    def fn_pathname(self, ref):
        key = text(ref).strip().lower()
        return self.s.libs[key][0] if key in self.s.libs else self.s.files.get(key, "")

    def fn_symget(self, name):
        return str(self.s.macro.vars.get(text(name).strip(), ""))

    def fn_symexist(self, name):
        return float(text(name).strip() in self.s.macro.vars)

    def fn_symglobl(self, name):
        return float(dict.__contains__(self.s.macro.vars, text(name).strip().lower()))

    def fn_symlocal(self, name):
        return float(any(text(name).strip().lower() in d for d in self.s.macro.vars.stack))

    def fn_resolve(self, s):
        return self.s.macro.resolve(text(s))

    def fn_sysmsg(self):
        return self.message

    def fn_sysrc(self):
        return float(bool(self.message))

    def fn_sysparm(self):
        return str(self.s.macro.vars.get("sysparm", ""))

    # Digests fed in parts.

    def fn_hashing_init(self, name):
        self.streams[float(len(self.streams) + 1)] = hashlib.new(text(name).strip().lower())
        return float(len(self.streams))

    def fn_hashing_hmac_init(self, name, key):
        self.streams[float(len(self.streams) + 1)] = hmac.new(text(key).encode(), digestmod=text(name).strip().lower())
        return float(len(self.streams))

    def fn_hashing_part(self, k, s):
        self.streams[float(k)].update(text(s).encode())
        return 0.0

    def fn_hashing_term(self, k):
        return self.streams.pop(float(k)).hexdigest().upper()


NAMES = {n[3:].upper() for n in dir(Handles) if n.startswith("fn_")}

_ATTRIBUTE = re.compile(r"V(INFORMAT|FORMAT|LABEL|LENGTH|TYPE)(N|W|D)?(X)?$")


def attribute(name: str, key: str, kind: str, attrs: dict):
    """VFORMAT, VFORMATN, VLABEL, VLENGTH and so on of a variable; X forms take its name."""
    m = _ATTRIBUTE.match(name)
    if not m:
        return NotImplemented
    a = attrs.get(key, {})
    if m[1] == "LABEL":
        return a.get("label") or a.get("name", key)
    if m[1] == "LENGTH":
        return float(a.get("len", 8))
    if m[1] == "TYPE":
        return "C" if kind == "c" else "N"
    spec = a.get(m[1].lower()) or ("$8." if kind == "c" else "BEST12." if m[1] == "FORMAT" else "F12.")
    n, w, d = split_spec(spec)
    return spec.upper() if not m[2] else n if m[2] == "N" else float(w) if m[2] == "W" else float(d)
