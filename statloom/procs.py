"""PROC steps: their statements read into options, and run by the operators."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statloom.formats import UnsupportedFeature, UserFormat, best, put
from statloom.operators import combine, correlation, exact, order, shape, summary, tables, univariate
from statloom.operators.order import RID, with_rid
from statloom.plans import expr as X
from statloom.plans.lexer import ProgramError, statements, tokenize
from statloom.plans.step import dataset_list, name_list

#: What lists print at most; a listing is for reading, the table keeps all rows.
PRINT_ROWS = 100_000


class Proc:
    """A PROC step's name, options and statements."""

    def __init__(self, session, text: str):
        self.s = session
        self.parts = statements(text)
        head = self.parts[0]
        m = re.match(r"proc\s+(\w+)\s*(.*)$", head, re.I | re.S)
        self.name, self.head = m[1].lower(), m[2]
        self.st: dict[str, list[str]] = {}
        for p in self.parts[1:]:
            word = re.match(r"\w+", p)[0].lower()
            self.st.setdefault(word, []).append(p[len(word) :].strip())

    def opt(self, key: str) -> str | None:
        m = re.search(rf"\b{key}\s*=\s*([\w.]+(?:\s*\([^=]*=.*?\)+)?|'[^']*'|\"[^\"]*\")", self.head, re.I)
        return m[1].strip("'\"") if m else None

    def flag(self, *words: str) -> bool:
        return any(re.search(rf"(?<![\w=]){w}\b(?!\s*=)", self.head, re.I) for w in words)

    def data(self, key: str = "data") -> DataFrame:
        from statloom.session import dataset_options

        m = re.search(rf"\b{key}\s*=\s*([\w.]+)\s*(\((?:[^()]|\([^()]*\))*\))?", self.head, re.I)
        name = m[1] if m else self.s.macro.vars.get("syslast", "_NULL_")
        df = self.s.table(name)
        if m and m[2]:
            df = dataset_options(df, dataset_list("x" + m[2])[0][1], keep_order=True)
        if "where" in self.st:
            df = self.where(df)
        return df

    def only(self, options: set[str], statements: set[str]) -> None:
        """Options and statements other than these end the program."""
        head = re.sub(r"\((?:[^()]|\([^()]*\))*\)", " ", self.head)
        given = re.findall(r"(\w+)\s*(?:=\s*(?:'[^']*'|\"[^\"]*\"|[\w.]+))?", head)
        for word in given:
            if word.lower() not in options:
                raise UnsupportedFeature(f"option {word.upper()} of PROC {self.name.upper()}")
        for word in self.st:
            if word not in statements | {"where", "format", "label", "run", "quit"} and not re.match(r"(title|footnote)\d*$", word):
                raise UnsupportedFeature(f"{word.upper()} in PROC {self.name.upper()}")

    def where(self, df: DataFrame) -> DataFrame:
        from statloom.session import env_of

        for w in self.st["where"]:
            p = X.Parser(tokenize(w))
            df = df.where(X.as_bool(X.to_column(p.parse(), env_of(df, self.s)), where=True))
        return df

    def out(self, key: str = "out") -> str | None:
        return self.opt(key)

    def names(self, word: str, df: DataFrame) -> list[str]:
        """The variables of a statement, in the data's spelling."""
        if word not in self.st:
            return []
        from statloom.session import expand_names

        cols = [c for c in df.columns if c != RID]
        low = {c.lower(): c for c in cols}
        got = []
        for text in self.st[word]:
            text = re.split(r"/", text)[0]
            for n in expand_names(name_list(text), cols):
                if n.lower() not in low:
                    raise ProgramError(f"variable {n} is not in the data")
                got.append(low[n.lower()])
        return got

    def by(self, df: DataFrame) -> list[str]:
        out, down = [], False
        low = {c.lower(): c for c in df.columns}
        for t in " ".join(self.st.get("by", [])).split():
            if t.lower() == "descending":
                down = True
            elif t.lower() != "notsorted":
                out.append(("-" if down else "") + low[t.lower()])
                down = False
        return out

    def numeric(self, df: DataFrame, skip=()) -> list[str]:
        return [f.name for f in df.schema if not isinstance(f.dataType, T.StringType) and f.name != RID and f.name not in skip]


def run(session, text: str) -> None:
    p = Proc(session, text)
    if p.name == "sql":
        from statloom.plans.sql import run_sql

        run_sql(session, text)
        return
    handler = globals().get(f"proc_{p.name}")
    if handler is None:
        raise UnsupportedFeature(f"PROC {p.name.upper()}")
    if p.name in KNOWN:
        p.only(*map(set, map(str.split, KNOWN[p.name])))
    handler(p)


#: Options and statements of each PROC; others end the program.
_MEANS = "data nway noprint missing vardef pctldef qntldef print order maxdec descending completetypes alpha fw nonobs chartype " + " ".join("n nmiss mean std stddev var min max sum range stderr cv median q1 q3 qrange mode css uss skewness skew kurtosis kurt sumwgt t prt probt clm lclm uclm p1 p5 p10 p20 p25 p30 p40 p50 p60 p70 p75 p80 p90 p95 p99".split())
KNOWN = {
    "print": ("data noobs label obs split n double width uniform", "var id by sum"),
    "sort": ("data out nodupkey nodup noduprecs nodups dupout sortseq equals noequals force tagsort linguistic ascii", "by"),
    "means": (_MEANS, "var class by weight freq types ways output id"),
    "summary": (_MEANS, "var class by weight freq types ways output id"),
    "freq": ("data noprint order", "tables table weight by exact"),
    "transpose": ("data out prefix suffix name let label delimiter", "by id var copy"),
    "rank": ("data out ties descending groups fraction percent normal savage", "by var ranks"),
    "standard": ("data out mean std m s replace noprint print", "by var"),
    "contents": ("data out noprint varnum order short nods", ""),
    "compare": ("base data compare comp out criterion method noprint listall briefsummary novalues outnoequal outbase outcomp outdif", "id var with"),
    "append": ("base out data new force", ""),
    "tabulate": ("data out format missing", "class var table tables"),
    "report": ("data out nowd nowindows headline headskip", "column columns define break rbreak"),
}

#: Options of FREQ's TABLES statement.
FREQ_TABLES = set("out outcum outpct outexpect missing missprint noprint nocum nopercent norow nocol nofreq list sparse chisq measures fisher exact relrisk riskdiff all agree trend jt cmh cmh1 cmh2 binomial p level alpha expected deviation cellchi2 totpct format printkwt scores testp testf nowarn crosslist".split())


def listing(session, df: DataFrame, labels: bool = False, number: bool = False) -> int:
    """Prints a table to the listing: columns padded to their widest value. More than
    PRINT_ROWS rows end the program."""
    rows = df.limit(PRINT_ROWS + 1).collect()
    if len(rows) > PRINT_ROWS:
        raise UnsupportedFeature(f"a listing of more than {PRINT_ROWS} rows")
    names = [c for c in df.columns if c != RID]
    specs = {f.name: f.metadata.get("format") for f in df.schema if f.metadata}
    heads = [(df.schema[c].metadata or {}).get("label", c) if labels else c for c in names]
    cells = [[_cell(r[c], specs.get(c), session) for c in names] for r in rows]
    if number:
        heads = ["Obs", *heads]
        cells = [[str(k), *c] for k, c in enumerate(cells, 1)]
    widths = [max([len(h), *(len(c[k]) for c in cells)]) for k, h in enumerate(heads)]
    left = [k - number >= 0 and isinstance(df.schema[names[k - number]].dataType, T.StringType) for k in range(len(heads))]
    for t in session.titles.values():
        session.listing.append(t)
    for line in [heads, *cells]:
        session.listing.append("  ".join(v.ljust(w) if lf else v.rjust(w) for v, w, lf in zip(line, widths, left)).rstrip())
    for t in session.footnotes.values():
        session.listing.append(t)
    return len(rows)


def _cell(v, spec, session) -> str:
    if spec:
        x = v if isinstance(v, str) or v is None else float(v)
        return put("" if v is None and spec.startswith("$") else x, spec, session.formats).strip()
    if v is None:
        return str(session.options.get("missing", "."))
    return v if isinstance(v, str) else best(float(v), 12).strip()


def _finish(p: Proc, df: DataFrame, name: str | None) -> None:
    if name:
        from statloom.session import dataset_options

        name = name.split("(")[0].strip()
        m = re.search(rf"\bout\w?\s*=\s*{re.escape(name)}\s*(\((?:[^()]|\([^()]*\))*\))", p.head, re.I)
        p.s.store(name, dataset_options(df, dataset_list("x" + m[1])[0][1], keep_order=True) if m else df)
        p.s.macro.vars["syslast"] = name.upper()
    table = p.s.ods.pop(p.name, None)
    if table:
        p.s.store(table, df)


def proc_print(p: Proc) -> None:
    df = p.data()
    shown = p.names("var", df) or [c for c in df.columns if c != RID]
    ids = p.names("id", df)
    by = p.by(df)
    rows = df.orderBy(*order.key_order(by), RID) if RID in df.columns else df
    cols = [*[b.lstrip("-") for b in by], *ids, *[c for c in shown if c not in ids and c not in by]]
    if m := re.search(r"\bobs\s*=\s*(\d+)", p.head, re.I):
        rows = rows.limit(int(m[1]))
    listing(p.s, rows.select(*cols), p.flag("label"), not p.flag("noobs") and not ids)
    for v in p.names("sum", df):
        keys = [b.lstrip("-") for b in by]
        total = df.groupBy(*keys).agg(F.sum(v).alias(v)) if keys else df.agg(F.sum(v).alias(v))
        listing(p.s, total)


def proc_sort(p: Proc) -> None:
    df, by = p.data(), None
    df = with_rid(df)
    by = p.by(df)
    name = p.out() or p.opt("data") or p.s.macro.vars.get("syslast")
    if re.search(r"sortseq\s*=\s*linguistic", p.head, re.I):
        df = df.orderBy(*[F.collate(F.col(k.lstrip("-")), "UNICODE").desc_nulls_last() if k[0] == "-" else F.collate(F.col(k), "UNICODE").asc_nulls_first() if isinstance(df.schema[k].dataType, T.StringType) else F.col(k).asc_nulls_first() for k in by], RID)
    dup = None
    if p.flag("nodupkey"):
        df, dup = order.nodupkey(df, by, [RID])
    elif p.flag("nodup", "noduprecs", "nodups"):
        df = order.noduprec(df, by, [RID])
    if (d := p.opt("dupout")) and dup is not None:
        p.s.store(d, with_rid(order.sort(dup, by).drop(RID)))
    _finish(p, with_rid(order.sort(df, by).drop(RID)), name)


_STATS = {"n", "nmiss", "mean", "std", "stddev", "var", "min", "max", "sum", "range", "stderr", "cv", "median", "q1", "q3", "qrange", "mode", "css", "uss", "skewness", "skew", "kurtosis", "kurt", "sumwgt", "t", "prt", "probt", "clm", "lclm", "uclm", *summary.PERCENTILES}


def proc_means(p: Proc) -> None:
    df = p.data()
    classes = p.names("class", df)
    by = [b.lstrip("-") for b in p.by(df)]
    weight, freq_ = (p.names(w, df) or [None] for w in ("weight", "freq"))
    var = p.names("var", df) or p.numeric(df, (*classes, *by, weight[0], freq_[0]))
    opts = {"classes": classes, "by": by, "nway": p.flag("nway"), "missing": p.flag("missing"), "weight": weight[0], "freq": freq_[0], "vardef": (p.opt("vardef") or "df").lower(), "pctldef": int(p.opt("pctldef") or p.opt("qntldef") or 5)}
    if "types" in p.st:
        opts["types"] = [[] if t == "()" else [next(c for c in classes if c.lower() == x.lower()) for x in t.split("*")] for t in " ".join(p.st["types"]).split()]
    if "ways" in p.st:
        opts["ways"] = [int(x) for x in " ".join(p.st["ways"]).split()]
    head_stats = [w.lower() for w in re.findall(r"(?<![=\w])\w+\b(?!\s*=)", p.head) if w.lower() in _STATS]
    for text in p.st.get("output", []):
        body, _, after = text.partition("/")
        out = re.search(r"out\s*=\s*([\w.]+)", body, re.I)[1]
        pairs = re.findall(r"(\w+)\s*(?:\(([\w\s]+)\))?\s*=\s*((?:(?!\b\w+\s*(?:\([\w\s]*\))?\s*=)[\w\s])*)", re.sub(r"out\s*=\s*[\w.]+(\([^)]*\))?", "", body, flags=re.I))
        names, stats = {}, []
        auto = "autoname" in after.lower()
        for stat, only, given in pairs:
            on = [next(v for v in var if v.lower() == o.lower()) for o in only.split()] or var
            wanted = given.split()
            key = stat.lower()
            stats.append(key) if key not in stats else None
            for k, v in enumerate(on):
                names[(v, key)] = wanted[k] if k < len(wanted) else f"{v}_{stat.capitalize() if len(stat) > 1 else stat.upper()}" if auto else v
        if not stats:
            made = summary.means_long(df, var, **opts)
        else:
            made = summary.means(df, var, tuple(stats), names={**{(v, s): f"__{v}_{s}" for v in var for s in stats}, **names}, id_vars=p.names("id", df), **opts)
            made = made.select(*[c for c in made.columns if not c.startswith("__")])
        p.s.store(out, made.orderBy(*by, "_TYPE_", *classes))
    if p.name == "means" and not p.flag("noprint"):
        stats = tuple(dict.fromkeys(x for s in head_stats or ["n", "mean", "std", "min", "max"] for x in (("lclm", "uclm") if s == "clm" else (s,))))
        shown = summary.means(df, var, stats, **{**opts, "nway": True})
        listing(p.s, shown.drop("_TYPE_").orderBy(*by, *classes) if by or classes else shown.drop("_TYPE_"))


proc_summary = proc_means


def proc_freq(p: Proc) -> None:
    df = p.data()
    weight = (p.names("weight", df) or [None])[0]
    low = {c.lower(): c for c in df.columns}
    by = [b.lstrip("-") for b in p.by(df)]
    for text in p.st.get("tables", []) + p.st.get("table", []):
        req, _, opts = text.partition("/")
        o = opts.lower()
        for word in re.findall(r"([a-z_]\w*)(?:\s*=\s*(?:\([^)]*\)|[\w.$]+))?", re.sub(r"\([^)]*\)", " ", o)):
            if word not in FREQ_TABLES:
                raise UnsupportedFeature(f"{word.upper()} in TABLES of PROC FREQ")
        out = re.search(r"out\s*=\s*([\w.]+)", opts, re.I)
        for item in re.findall(r"[\w]+(?:\s*\*\s*\w+)*", req):
            cols = [low[c.strip().lower()] for c in item.split("*")]
            made = summary.freq(df, cols, weight, bool(re.search(r"\bmissing\b", o)), "outcum" in o or len(cols) == 1 and not out, by, "zeros" in p.st.get("weight", [""])[0].lower())
            if out:
                p.s.store(out[1], made.orderBy(*by, *cols))
            if "noprint" not in o and not p.flag("noprint"):
                listing(p.s, made.orderBy(*by, *cols))
            if len(cols) == 2 and any(w in o for w in ("chisq", "measures", "fisher", "exact", "relrisk", "riskdiff", "all")):
                stats = tables.association(df, *cols, weight)
                listing(p.s, stats)
                if t := p.s.ods.pop("chisq", None):
                    p.s.store(t, stats)
            if len(cols) == 2 and "exact" in p.st:
                _exact(p, df, cols, weight)
            if len(cols) == 2 and any(re.search(rf"\b{w}\b", o) for w in ("agree", "trend", "jt", "cmh")):
                _agree(p, df, cols, weight, o)
            if len(cols) == 3 and "cmh" in o:
                _cmh(p, df, cols, weight)
            if len(cols) == 1 and "binomial" in o:
                got = made.orderBy(*cols).collect()
                x, n = int(got[0]["COUNT"]), int(sum(r["COUNT"] for r in got))
                b = tables.binomial(x, n, float((re.search(r"p\s*=\s*([\d.]+)", o) or [0, 0.5])[1]))
                listing(p.s, p.s.spark.createDataFrame([(k, float(v)) for k, v in b.items()], "statistic string, value double"))
            if len(cols) == 1 and "chisq" in o:
                import numpy as np

                got = made.orderBy(*cols).collect()
                x, d, pr = tables.goodness_of_fit(np.array([r["COUNT"] for r in got]))
                listing(p.s, p.s.spark.createDataFrame([("Chi-Square", x, float(d), pr)], "statistic string, value double, df double, p double"))


def _exact(p, df, cols, weight):
    """The EXACT statement's tests of a two-way table."""
    t, _, _ = tables.table_of(df, *cols, weight)
    text = " ".join(p.st["exact"]).lower()
    n = int((re.search(r"\bn\s*=\s*(\d+)", text) or [0, 10_000])[1])
    rows = []
    for word, name, stat in (("fisher", "Fisher", "fisher"), ("pchi", "Pearson", "pearson"), ("chisq", "Pearson", "pearson"), ("lrchi", "Likelihood Ratio", "lr"), ("mhchi", "Mantel-Haenszel", "mh")):
        if re.search(rf"\b{word}\b", text):
            rows.append((f"{name} exact p", exact.monte_carlo_p(t, stat, n)[0] if re.search(r"\bmc\b", text) and stat != "fisher" else exact.exact_p(t, stat)))
    if t.shape == (2, 2):
        if re.search(r"\bor\b", text):
            lo, hi = exact.odds_ratio_limits(t)
            rows += [("Odds ratio exact lower", lo), ("Odds ratio exact upper", hi)]
        if "barnard" in text:
            rows.append(("Barnard p", exact.barnard(t)))
        if "riskdiff" in text:
            rows += [(f"Risk difference {k} {side}", v[j]) for k, v in exact.risk_difference_limits(t).items() for j, side in enumerate(("lower", "upper"))]
    listing(p.s, p.s.spark.createDataFrame([(k, float(v)) for k, v in rows] or [("none", 0.0)], "statistic string, value double"))


def _agree(p, df, cols, weight, o):
    t, _, _ = tables.table_of(df, *cols, weight)
    rows = []
    if "agree" in o and t.shape[0] == t.shape[1]:
        if t.shape == (2, 2):
            x, pr, ex = tables.mcnemar(t)
            rows += [("McNemar", x, pr), ("McNemar exact", None, ex)]
        else:
            x, d, pr = tables.bowker(t)
            rows.append(("Bowker", x, pr))
        k, se = tables.kappa(t)
        rows.append(("Simple Kappa", k, se))
        k, se = tables.kappa(t, tables.linear_weights(len(t)))
        rows.append(("Weighted Kappa", k, se))
    if "trend" in o:
        rows.append(("Cochran-Armitage Trend", *tables.trend(t)))
    if re.search(r"\bjt\b", o):
        _, z, pr = tables.jonckheere(t)
        rows.append(("Jonckheere-Terpstra", z, pr))
    if "cmh" in o:
        rows += [(k, v[0], v[2]) for k, v in tables.cmh([t]).items()]
    clean = [(a, None if b is None or b != b else float(b), None if c is None or c != c else float(c)) for a, b, c in rows]
    listing(p.s, p.s.spark.createDataFrame(clean, "statistic string, value double, p_or_ase double"))


def _cmh(p, df, cols, weight):
    import numpy as np

    cells = summary.freq(df, cols, weight).limit(tables.MOST_CELLS + 1).collect()
    if len(cells) > tables.MOST_CELLS:
        raise ValueError(f"more than {tables.MOST_CELLS} cells")
    lv = [sorted({c[k] for c in cells}) for k in range(3)]
    strata = [np.zeros((len(lv[1]), len(lv[2]))) for _ in lv[0]]
    for c in cells:
        strata[lv[0].index(c[0])][lv[1].index(c[1]), lv[2].index(c[2])] = c["COUNT"]
    rows = [(k, float(v[0]), None if v[1] != v[1] else float(v[1]), None if v[2] != v[2] else float(v[2])) for k, v in tables.cmh(strata).items()]
    if strata[0].shape == (2, 2):
        rows += [(f"{k} {side}", float(v[j]), None, None) for k, v in exact.mantel_haenszel(strata).items() for j, side in enumerate(("estimate", "lower", "upper"))]
    out = p.s.spark.createDataFrame(rows, "statistic string, value double, df double, p double")
    listing(p.s, out)
    if t := p.s.ods.pop("cmh", None):
        p.s.store(t, out)


def proc_transpose(p: Proc) -> None:
    df = with_rid(p.data())
    by = [b.lstrip("-") for b in p.by(df)]
    ids, copy = p.names("id", df), p.names("copy", df)
    var = p.names("var", df) or p.numeric(df, (*by, *ids, *copy))
    prefix, suffix, name = p.opt("prefix") or "", p.opt("suffix") or "", p.opt("name") or "_NAME_"
    if ids:
        key = ids[0]
        if len(ids) > 1:
            key = "__id"
            df = df.withColumn(key, F.concat_ws("", *[F.col(i).cast("string") for i in ids]))
        made = shape.transpose_wide(df, by, key, var, [RID], None, prefix, suffix, p.flag("let"))
    else:
        n = F.row_number().over(Window.partitionBy(*by).orderBy(RID)).cast("double")
        most = int(df.withColumn("__k", n).agg(F.max("__k")).first()[0] or 0)
        if most > 10_000:
            raise ValueError("more than 10000 rows in a BY group would be as many columns")
        made = shape.transpose_wide(df.withColumn("__k", n), by, "__k", var, [RID], [float(k) for k in range(1, most + 1)], prefix or "COL", suffix, True)
    made = made.withColumnRenamed("_NAME_", name)
    if copy:
        first = df.groupBy(*by).agg(*[F.min_by(c, RID).alias(c) for c in copy])
        made = made.join(first, by)
    _finish(p, made.orderBy(*by) if by else made, p.out() or "data1")


def proc_rank(p: Proc) -> None:
    df = p.data()
    by = [b.lstrip("-") for b in p.by(df)]
    var, ranks = p.names("var", df) or p.numeric(df), " ".join(p.st.get("ranks", [])).split()
    if p.flag("fraction", "percent", "normal", "savage"):
        raise UnsupportedFeature("PROC RANK FRACTION, PERCENT, NORMAL, SAVAGE")
    for k, v in enumerate(var):
        out = ranks[k] if k < len(ranks) else v
        made = shape.rank(df.withColumnRenamed(v, "__v") if out == v else df, "__v" if out == v else v, out, by, (p.opt("ties") or "mean").lower(), p.flag("descending"), int(p.opt("groups")) if p.opt("groups") else None)
        df = made.drop("__v") if out == v else made
    _finish(p, df, p.out() or "data1")


def proc_standard(p: Proc) -> None:
    df = p.data()
    num = lambda k: float(p.opt(k)) if p.opt(k) is not None else None
    made = shape.standardise(df, p.names("var", df) or p.numeric(df), [b.lstrip("-") for b in p.by(df)], num("mean"), num("std"), p.flag("replace"))
    _finish(p, made, p.out() or "data1")


def proc_contents(p: Proc) -> None:
    df = p.data()
    rows = shape.contents(df.drop(RID), (p.opt("data") or "").upper())
    made = p.s.spark.createDataFrame([tuple(r.values()) for r in rows], "MEMNAME string, NAME string, TYPE int, LENGTH int, VARNUM int, FORMAT string, INFORMAT string, LABEL string")
    if not p.flag("noprint"):
        listing(p.s, made)
    _finish(p, made, p.out())


def proc_format(p: Proc) -> None:
    for kind in ("value", "invalue", "picture"):
        for text in p.st.get(kind, []):
            m = re.match(r"(\$?\w+)\s*(?:\([^)]*\))?\s*(.*)$", text, re.S)
            fmt = UserFormat(("@" if kind == "invalue" else "") + m[1])
            char = m[1].startswith("$")
            for left, right, tail in re.findall(r"((?:'[^']*'|\"[^\"]*\"|[^='\"])+?)\s*=\s*('[^']*'|\"[^\"]*\"|\[[^\]]*\]|_same_|[-\w.]+)\s*(\((?:[^()'\"]|'[^']*'|\"[^\"]*\")*\))?", m[2]):
                label = right[1:-1] if right[0] in "'\"" else right
                if kind == "invalue" and right[0] not in "'\"" and right != "_same_":
                    label = X.to_number(right)
                for item in re.findall(r"(?:'[^']*'|\"[^\"]*\"|[^,'\"])+", left):
                    item = item.strip()
                    if not item:
                        continue
                    if item.lower() == "other":
                        fmt.other = label
                        continue
                    fmt.ranges.append((*_range(item, char or kind == "invalue"), label))
                if kind == "picture":
                    opts = {k.lower(): v.strip("'\"") for k, v in re.findall(r"(\w+)\s*=\s*('[^']*'|\"[^\"]*\"|[\w.]+)", tail or "")}
                    if "mult" in opts or "multiplier" in opts:
                        opts["mult"] = float(opts.get("mult") or opts.get("multiplier"))
                    fmt.picture[label] = opts
            p.s.formats.add(fmt)
    if name := p.opt("cntlin"):
        made: dict[str, UserFormat] = {}
        for r in p.s.rows(name).collect():
            d = {k.lower(): v for k, v in r.asDict().items()}
            kind = (d.get("type") or "N").strip().upper()
            key = ("$" if kind == "C" and not d["fmtname"].startswith("$") else "") + d["fmtname"].strip()
            fmt = made.setdefault(key, UserFormat(key))
            hlo = (d.get("hlo") or "").upper()
            if "O" in hlo:
                fmt.other = d["label"]
                continue
            conv = (lambda v: v.strip() if isinstance(v, str) else v) if kind == "C" else (lambda v: X.number(v))
            lo = None if "L" in hlo else conv(d["start"])
            hi = None if "H" in hlo else conv(d.get("end", d["start"]))
            fmt.ranges.append((lo, hi, (d.get("sexcl") or "N").strip() == "Y", (d.get("eexcl") or "N").strip() == "Y", d["label"]))
            if kind == "P":
                fmt.picture[d["label"]] = {"prefix": (d.get("prefix") or "").strip()}
        for fmt in made.values():
            p.s.formats.add(fmt)


def _range(item: str, char: bool):
    m = re.match(r"('[^']*'|\"[^\"]*\"|low|-?[\d.]+|\.|\w+)\s*(<)?\s*(?:-\s*(<)?\s*('[^']*'|\"[^\"]*\"|high|-?[\d.]+|\w+))?$", item, re.I)
    if not m:
        raise ProgramError(f"range not known: {item}")

    def end(t):
        if t[0] in "'\"":
            return t[1:-1]
        return None if t.lower() in ("low", "high", ".") else t if char else float(t)

    lo, hi = end(m[1]), end(m[4]) if m[4] else end(m[1])
    return lo, hi, bool(m[2]), bool(m[3])


def proc_datasets(p: Proc) -> None:
    s = p.s
    if p.flag("kill"):
        s.work.clear()
    for text in p.st.get("delete", []):
        for n in text.split():
            s.work.pop(n.lower(), None)
    for text in p.st.get("change", []):
        for a, b in re.findall(r"(\w+)\s*=\s*(\w+)", text):
            s.work[b.lower()] = s.work.pop(a.lower())
    for text in p.st.get("append", []):
        base, data = (re.search(rf"{k}\s*=\s*([\w.]+)", text, re.I)[1] for k in ("base", "data"))
        _append(s, base, data, bool(re.search(r"\bforce\b", text, re.I)))
    current = None
    for part in p.parts[1:]:
        word, _, rest = part.partition(" ")
        if word.lower() == "modify":
            current = re.match(r"[\w.]+", rest.strip())[0]
        elif current and word.lower() == "rename":
            df = s.table(current)
            low = {c.lower(): c for c in df.columns}
            s.store(current, df.withColumnsRenamed({low[a.lower()]: b for a, b in re.findall(r"(\w+)\s*=\s*(\w+)", rest)}))
        elif current and word.lower() in ("label", "format"):
            df = s.table(current)
            low = {c.lower(): c for c in df.columns}
            pairs = re.findall(r"(\w+)\s*=\s*(?:'([^']*)'|\"([^\"]*)\")", rest) if word.lower() == "label" else [(a, b, "") for a, b in re.findall(r"(\w+)\s+(\S+\.\d*)", rest)]
            for a, b, c in pairs:
                name = low[a.lower()]
                df = df.withMetadata(name, dict(df.schema[name].metadata or {}) | {word.lower(): b or c})
            s.store(current, df)
    for text in p.st.get("contents", []):
        m = re.search(r"data\s*=\s*([\w.]+)", text, re.I)
        listing(s, s.spark.createDataFrame([(r["NAME"], r["TYPE"]) for r in shape.contents(s.table(m[1]).drop(RID))], "NAME string, TYPE int"))
    for text in p.st.get("copy", []):
        _copy(p, text)


def proc_delete(p: Proc) -> None:
    for n in re.search(r"data\s*=\s*(.*)$", p.head, re.I | re.S)[1].split():
        p.s.work.pop(n.lower().removeprefix("work."), None)


def _append(s, base, data, force):
    if not s.exists(base):
        s.store(base, s.table(data))
        return
    a, b = s.table(base), s.table(data)
    fit = combine.append(a.drop(RID).limit(0), b.drop(RID), force)
    joined = combine.concatenate(a, with_rid(fit)).withColumn(RID, F.col("__src").cast("long") * F.lit(1 << 53) + F.col(RID)).drop("__src")
    s.store(base, joined)


def proc_append(p: Proc) -> None:
    _append(p.s, p.opt("base") or p.opt("out"), p.opt("data") or p.opt("new"), p.flag("force"))


def _copy(p: Proc, text: str) -> None:
    src, dst = (re.search(rf"\b{k}\s*=\s*(\w+)", text, re.I)[1].lower() for k in ("in", "out"))
    names = " ".join(p.st.get("select", [])).split() or (list(p.s.work) if src == "work" else [])
    for n in names:
        df = p.s.table(n if src == "work" else f"{src}.{n}")
        p.s.store(n if dst == "work" else f"{dst}.{n}", df)


def proc_copy(p: Proc) -> None:
    _copy(p, p.head)


def proc_compare(p: Proc) -> None:
    base, comp = p.s.table(p.opt("base") or p.opt("data")), p.s.table(p.opt("compare"))
    ids = p.names("id", base)
    if not ids:
        base = order.row_numbers(with_rid(base), [RID], "_OBS_").drop(RID)
        comp = order.row_numbers(with_rid(comp), [RID], "_OBS_").drop(RID)
        ids = ["_OBS_"]
    low = {c.lower() for c in comp.columns}
    var = p.names("var", base) or [c for c in base.columns if c != RID and c not in ids and c.lower() in low]
    with_ = " ".join(p.st.get("with", [])).split() or None
    crit = p.opt("criterion")
    made = shape.compare(base, comp, ids, var, with_, float(crit) if crit else 1e-8, (p.opt("method") or ("relative" if not crit else "relative")).lower())
    n = made.count()
    p.s.macro.vars["sysinfo"] = str(int(n > 0))
    p.s.listing.append(f"Number of observations with some compared variables unequal: {n}")
    _finish(p, made.orderBy(*ids), p.out())


def proc_export(p: Proc) -> None:
    from statloom.sources import members

    df = p.data()
    fmt = {f.name.lower(): f.metadata["format"] for f in df.schema if f.metadata and "format" in f.metadata}
    dlm = next((re.search(r"=\s*['\"](.*)['\"]", t)[1] for t in p.st.get("delimiter", [])), "\t" if (p.opt("dbms") or "").lower() == "tab" else ",")
    header = not any("no" in t.lower() for t in p.st.get("putnames", []))
    members.write_csv(df, p.opt("outfile") or p.opt("file"), dlm, header, fmt)


def proc_import(p: Proc) -> None:
    from statloom.sources import members

    path, dbms = p.opt("datafile") or p.opt("file"), (p.opt("dbms") or "csv").lower()
    path = p.s.files.get(path.lower(), path)
    names = not any("no" in t.lower() for t in p.st.get("getnames", []))
    if dbms in ("xlsx", "excel"):
        df = members.read_xlsx(p.s.spark, path, 1, names)
    else:
        dlm = next((re.search(r"=\s*['\"](.*)['\"]", t)[1] for t in p.st.get("delimiter", [])), "\t" if dbms == "tab" else ",")
        df = members.read_csv(p.s.spark, path, dlm, names)
    p.s.store(p.opt("out"), df)


def proc_corr(p: Proc) -> None:
    p.only({"data", "out", "outp", "pearson", "spearman", "kendall", "alpha", "noprint", "nosimple", "noprob"}, {"var", "with", "weight"})
    df = p.data()
    var = p.names("var", df) or p.numeric(df)
    with_ = p.names("with", df)
    weight = (p.names("weight", df) or [None])[0]
    made = correlation.pearson(df, list(dict.fromkeys([*with_, *var])), weight)
    if with_:
        made = made.where(F.col("x").isin(with_) & F.col("y").isin(var))
    listing(p.s, made)
    if p.flag("spearman"):
        for i, a in enumerate(var):
            for b in var[i + 1 :]:
                listing(p.s, correlation.spearman(df, a, b).select(F.lit(a).alias("x"), F.lit(b).alias("y"), "r", "n", "p"))
    if p.flag("kendall"):
        for i, a in enumerate(var):
            for b in var[i + 1 :]:
                listing(p.s, correlation.kendall(df, a, b))
    if p.flag("alpha"):
        listing(p.s, correlation.cronbach_alpha(df, var))
    _finish(p, made, p.out("outp") or p.out("out"))


def proc_univariate(p: Proc) -> None:
    p.only({"data", "noprint", "pctldef", "def"}, {"var", "class", "by", "output"})
    df = p.data()
    by = [b.lstrip("-") for b in p.by(df)]
    classes = p.names("class", df)
    keys = [*by, *classes]
    var = p.names("var", df) or p.numeric(df, keys)
    definition = int(p.opt("pctldef") or p.opt("def") or 5)
    if not p.flag("noprint"):
        for v in var:
            made = univariate.moments(df, v, keys)
            listing(p.s, made.orderBy(*keys) if keys else made)
    for text in p.st.get("output", []):
        out = re.search(r"out\s*=\s*([\w.]+)", text, re.I)[1]
        body = re.sub(r"out\s*=\s*[\w.]+", "", text, flags=re.I)
        points = re.search(r"pctlpts\s*=\s*([\d.\s,]+|[\d.]+\s+to\s+[\d.]+(?:\s+by\s+[\d.]+)?)(?=\s*(?:\w+\s*=|$))", body, re.I)
        heads = re.search(r"pctlpre\s*=\s*((?:\w+\s*(?!\s*=))+?)(?=\s*(?:\w+\s*=|$))", body, re.I)
        if re.search(r"pctl", body, re.I) and not (points and heads):
            raise UnsupportedFeature("these PCTL options in OUTPUT of PROC UNIVARIATE")
        for m in (points, heads):
            body = body.replace(m[0], " ") if m else body
        names, stats = {}, []
        for stat, given in re.findall(r"(\w+)\s*=\s*((?:(?!\b\w+\s*=)[\w\s])*)", body):
            key, given = stat.lower(), given.split()
            if key not in _STATS:
                raise UnsupportedFeature(f"{stat.upper()} in OUTPUT of PROC UNIVARIATE")
            stats.append(key)
            names |= {(v, key): n for v, n in zip(var, given)}
        if left := re.sub(r"\w+\s*=\s*((?:(?!\b\w+\s*=)[\w\s])*)", "", body).split():
            raise UnsupportedFeature(f"{left[0].upper()} in OUTPUT of PROC UNIVARIATE")
        hidden = {(v, k): f"__{v}_{k}" for v in var for k in stats if (v, k) not in names}
        got = summary.means(df, var, tuple(stats), classes=classes, by=by, nway=True, names=names | hidden, pctldef=definition)
        got = got.select(*[c for c in got.columns if not c.startswith("__") and c not in ("_TYPE_", "_FREQ_")])
        if points:
            at = re.findall(r"[\d.]+", points[1])
            if "to" in points[1].lower():
                lo, hi, step = (float(x) for x in [*at, "1"][:3])
                at = [f"{lo + k * step:g}" for k in range(int((hi - lo) / step + 1e-9) + 1)]
            if clean := classes:
                df = df.where(" and ".join(f"`{c}` is not null" for c in clean))
            for v, head in zip(var, heads[1].split()):
                wanted = {f"{head}{x.replace('.', '_')}": (format(float(x) / 100, ".15g"), definition) for x in at}
                found = summary.order_statistics(df, keys, v, wanted).withColumnsRenamed({k: f"__q{n}" for n, k in enumerate(keys)})
                same = [F.col(k).eqNullSafe(F.col(f"__q{n}")) for n, k in enumerate(keys)]
                got = (got.join(found, same, "left") if keys else got.crossJoin(F.broadcast(found))).drop(*[f"__q{n}" for n in range(len(keys))])  # without keys, a row each
        p.s.store(out, got.orderBy(*keys) if keys else got)


def proc_tabulate(p: Proc) -> None:
    df = p.data()
    var = p.names("var", df)
    text = p.st["table"][0].split("/")[0] if "table" in p.st else p.st["tables"][0].split("/")[0]
    dims = text.split(",")
    rows, cols = (dims[0], dims[1]) if len(dims) > 1 else (dims[0], "")
    low = {c.lower(): c for c in p.names("class", df)}
    pick = lambda t: [low[w.lower()] for w in re.findall(r"\w+", t) if w.lower() in low]
    stats = tuple(w.lower() for w in re.findall(r"\w+", text) if w.lower() in ("n", "sum", "mean", "min", "max", "std", "pctn", "pctsum")) or (("sum",) if var else ("n",))
    if "*" in rows and len(pick(rows)) > 1:
        raise UnsupportedFeature("crossed row classes")
    made = summary.tabulate(df, pick(rows), pick(cols), var[0] if var else None, stats, bool(re.search(r"\ball\b", rows, re.I)), bool(re.search(r"\ball\b", cols, re.I)))
    listing(p.s, made.orderBy(*pick(rows), *pick(cols)) if pick(rows) or pick(cols) else made)
    _finish(p, made, p.out())


def proc_report(p: Proc) -> None:
    df = p.data()
    cols = re.findall(r"\w+", " ".join(p.st.get("column", []) + p.st.get("columns", [])))
    use = {}
    for text in p.st.get("define", []):
        m = re.match(r"(\w+)\s*/\s*(.*)$", text, re.S)
        use[m[1].lower()] = m[2].lower()
    if any("across" in u for u in use.values()):
        raise UnsupportedFeature("ACROSS")
    low = {c.lower(): c for c in df.columns}
    groups = [low[c.lower()] for c in cols if "group" in use.get(c.lower(), "")]
    stats = {low[c.lower()]: next((w for w in re.findall(r"\w+", use[c.lower()]) if w in ("sum", "mean", "n", "min", "max", "std")), "sum") for c in cols if c.lower() in low and "analysis" in use.get(c.lower(), "")}
    if groups:
        for c in cols:
            if c.lower() in low and low[c.lower()] not in groups and low[c.lower()] not in stats and not isinstance(df.schema[low[c.lower()]].dataType, T.StringType):
                stats[low[c.lower()]] = "sum"
        breaks = [low[re.match(r"after\s+(\w+)", t, re.I)[1].lower()] for t in p.st.get("break", []) if re.match(r"after", t, re.I)]
        made = summary.report(df, groups, stats, breaks, "rbreak" in p.st)
        made = made.orderBy(*[F.col(g).asc_nulls_last() for g in groups])
    else:
        orders = [low[c.lower()] for c in cols if "order" in use.get(c.lower(), "")]
        made = df.orderBy(*orders, *([RID] if RID in df.columns else [F.lit(1)])).select(*[low[c.lower()] for c in cols if c.lower() in low])
    listing(p.s, made)
    _finish(p, made, p.out())


def proc_printto(p: Proc) -> None:
    """Accepted and without effect."""
