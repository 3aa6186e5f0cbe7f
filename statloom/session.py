"""Programs: text through the macro layer to steps, steps to tables.

Session(spark).run(text) runs DATA steps, PROCs, PROC SQL and global statements. WORK is a
dict of DataFrames; a libref is a folder of members. A DATA step that columns can say is a
Spark plan; any other goes through the row interpreter, in order."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statloom.formats import Catalog, UnsupportedFeature
from statloom.functions.handles import NAMES as HANDLE_NAMES
from statloom.functions.handles import Handles
from statloom.macro import Macro
from statloom.operators import combine
from statloom.operators.order import RID, key_order, plain, with_rid
from statloom.plans import expr as X
from statloom.plans.interp import Interpreter
from statloom.plans.lexer import ProgramError
from statloom.plans.step import Source, Step, StepParser, dataset_list


class Session:
    """State of a run: libraries, formats, macro variables, options, log and listings."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.work: dict[str, DataFrame] = {}
        self.libs: dict[str, tuple[str, bool]] = {}
        self.files: dict[str, str] = {}
        self.formats = Catalog()
        self.macro = Macro(self)
        self.options: dict[str, object] = {"obs": None, "firstobs": 1, "missing": ".", "yearcutoff": 1926}
        self.titles: dict[int, str] = {}
        self.footnotes: dict[int, str] = {}
        self.log: list[str] = []
        self.listing: list[str] = []
        self.ods: dict[str, str] = {}
        self.handles = Handles(self)
        self.rc = 0

    # -- tables

    def table(self, name: str) -> DataFrame:
        low = name.lower()
        lib, _, member = low.rpartition(".")
        if lib in ("dictionary", "sashelp"):
            return self.dictionary(member)
        if lib in ("", "work"):
            if member not in self.work:
                raise ProgramError(f"dataset {name} does not exist")
            return self.work[member]
        if lib not in self.libs:
            raise ProgramError(f"libref {lib} is not assigned")
        from statloom.sources import members

        return with_rid(members.read_member(self.spark, self.libs[lib][0], member))

    def exists(self, name: str) -> bool:
        try:
            self.table(name)
            return True
        except (ProgramError, FileNotFoundError):
            return False

    def store(self, name: str, df: DataFrame) -> None:
        """Registers a result; only a step that ended well gets here."""
        low = name.lower()
        lib, _, member = low.rpartition(".")
        if lib in ("", "work"):
            self.work[member] = with_rid(df)
            self.work[member].drop(RID).createOrReplaceTempView(member)
            return
        path, readonly = self.libs[lib]
        if readonly:
            raise ProgramError(f"libref {lib} is read-only")
        from statloom.sources import members

        members.write_member(df, path, member)

    def rows(self, name: str) -> DataFrame:
        """A table without its order column, in order."""
        df = self.table(name)
        return df.orderBy(RID).drop(RID) if RID in df.columns else df

    def dictionary(self, what: str) -> DataFrame:
        """dictionary.tables/columns and sashelp.vtable/vcolumn."""
        tables, columns = [], []
        for name, df in sorted(self.work.items()):
            fields = [f for f in df.schema if f.name != RID]
            tables.append(("WORK", name.upper(), "DATA", len(fields)))
            for k, f in enumerate(fields, 1):
                char = isinstance(f.dataType, T.StringType)
                columns.append(("WORK", name.upper(), f.name, "char" if char else "num", float(f.metadata.get("len", 8)), float(k), f.metadata.get("label", ""), f.metadata.get("format", "")))
        if what in ("tables", "vtable"):
            return with_rid(self.spark.createDataFrame(tables, "libname string, memname string, memtype string, nvar int"))
        if what in ("columns", "vcolumn"):
            return with_rid(self.spark.createDataFrame(columns, "libname string, memname string, name string, type string, length double, varnum double, label string, format string"))
        raise UnsupportedFeature(f"dictionary.{what}")

    # -- running

    def run(self, text: str) -> int:
        """Runs a program; the exit class: 0 well, 1 an error in the program, 2 a feature
        that isn't offered. After an error later steps are skipped."""
        from statloom import procs

        for step in self.macro.steps(text):
            try:
                self.one(step, procs)
            except UnsupportedFeature as e:
                self.log.append(f"ERROR: not supported: {e}")
                self.rc = 2
                break
            except (ProgramError, ValueError, KeyError, FileNotFoundError) as e:
                self.log.append(f"ERROR: {e}")
                self.rc = max(self.rc, 1)
                break
        return self.rc

    def one(self, step: str, procs) -> None:
        word = (re.match(r"\s*([A-Za-z_]\w*)", step) or ["", ""])[1].lower()
        if word == "data":
            self.data_step(step)
            for code in self.macro.vars.pop("__execute__", []):
                self.run(code)
        elif word == "proc":
            procs.run(self, step)
        elif word:
            self.global_(step)

    def global_(self, step: str) -> None:
        s = step.strip().rstrip(";").strip()
        word, _, rest = s.partition(" ")
        low = word.lower()
        if m := re.match(r"(title|footnote)(\d*)$", low):
            book = self.titles if m[1] == "title" else self.footnotes
            k = int(m[2] or 1)
            for j in [j for j in book if j >= k]:
                del book[j]
            if rest.strip():
                book[k] = rest.strip().strip("'\"")
        elif low == "libname":
            name, _, path = rest.strip().partition(" ")
            if path.strip().lower() == "clear":
                self.libs.pop(name.lower(), None)
            else:
                m = re.search(r"(['\"])(.*?)\1", path)
                self.libs[name.lower()] = (m[2], bool(re.search(r"access\s*=\s*readonly", path, re.I)))
        elif low == "filename":
            name, _, path = rest.strip().partition(" ")
            self.files[name.lower()] = path.strip().strip("'\"")
        elif low == "options":
            for key, value in re.findall(r"(\w+)\s*=\s*(\S+)", rest):
                k = key.lower()
                self.options[k] = None if value.lower() == "max" else int(value) if value.isdigit() else value
                if k == "yearcutoff":
                    from statloom.functions import dates

                    dates.CUTOFF = int(value)
        elif low in ("ods", "x", "run", "quit", "goptions", "dm", "page", "skip", "missing", "endsas"):
            if low == "ods" and (m := re.match(r"output\s+(\w+)\s*=\s*([\w.]+)", rest.strip(), re.I)):
                self.ods[m[1].lower()] = m[2]
        else:
            raise ProgramError(f"statement not known: {s[:40]}")

    # -- DATA steps

    def data_step(self, text: str) -> None:
        step = StepParser(text).parse()
        try:
            outputs = Declarative(self, step).build()
        except NotDeclarative:
            outputs = self.interpreted(step)
        for name, opts in step.targets:
            df = outputs[name.lower()]
            self.store(name, dataset_options(finish(df, step), opts))

    def source(self, src: Source, flags: bool = True) -> DataFrame:
        """The rows that SET, MERGE, UPDATE or MODIFY brings, with its order in __rid."""
        frames, names = [], []
        for k, (name, opts) in enumerate(src.datasets):
            df = self.table(name)
            if self.options["obs"] is not None and RID in df.columns:
                df = with_rid(df.orderBy(RID).limit(int(self.options["obs"])))
            df = dataset_options(df, opts, keep_order=True)
            frames.append(df)
            names.append((opts.get("in") or f"__s{k}").lower())
        by = plain(src.by)
        if src.kind == "set" and not src.by:
            out = combine.concatenate(*frames) if len(frames) > 1 else frames[0]
            if len(frames) > 1:
                out = self._in_flags(out, names)
                out = out.withColumn(RID, F.col("__src").cast("long") * F.lit(1 << 53) + F.col(RID)).drop("__src")
            return out
        if src.kind == "set":
            out = combine.concatenate(*frames)
            out = self._in_flags(out, names).withColumn(RID, F.col("__src").cast("long") * F.lit(1 << 53) + F.col(RID)).drop("__src")
            return out
        if src.kind == "merge" and src.by:
            keyed = {n: f for n, f in zip(names, frames)}
            out = combine.merge_by(keyed, by, {n: [RID] for n in names})
            out = out.withColumnsRenamed({f"in_{n}": n for n in names})
            return out.withColumn(RID, F.col("__n").cast("long")).drop("__n")
        if src.kind == "merge":
            out = combine.merge_positional(*frames, order=[[RID]] * len(frames))
            return out.withColumnRenamed("__n", RID)
        master, trans = frames
        if src.kind == "update":
            return with_rid(combine.update(master, trans, by, [RID], src.options.get("updatemode") != "nomissingcheck"))
        return with_rid(combine.modify(master, trans, by, [RID]))

    def _in_flags(self, df, names):
        for k, n in enumerate(names):
            if not n.startswith("__s"):
                df = df.withColumn(n, F.when(F.col("__src") == k, 1.0).otherwise(0.0))
        return df

    def interpreted(self, step: Step) -> dict[str, DataFrame]:
        """The step by the row interpreter: on the driver without sources, else over the
        ordered rows in one task."""
        tables = {}
        for text in self._lookups(step):
            ((name, opts),) = dataset_list(text)
            df = dataset_options(self.table(name), opts, keep_order=True)
            df = df.orderBy(RID).drop(RID) if RID in df.columns else df
            tables[text.lower()] = [r.asDict() for r in as_values(df).limit(1_000_001).collect()]
            if len(tables[text.lower()]) > 1_000_000:
                raise UnsupportedFeature(f"a hash or POINT= table of over a million rows: {name}")
        reads = [s for s in step.sources if "point" not in s.options]
        lines = step.datalines
        if lines is None and step.infile:
            path = step.infile["file"]
            path = self.files.get(path.lower(), path)
            lines = [r[0] for r in self.spark.read.text(path).collect()]
        if lines is not None and step.infile.get("firstobs"):
            lines = lines[step.infile["firstobs"] - 1 :]
        if not reads:
            it = Interpreter(step, {}, tables, self.macro.vars, self.formats, lines, self.handles)
            it.run(None)
            self.log += it.log
            out = {n: self._frame(rows, it) for n, rows in it.out.items()}
            for n, rows in it.out.items():
                if n not in {t.lower() for t, _ in step.targets}:
                    self.store(n, self._frame(rows, it))
            return out
        if len(reads) > 1:
            raise UnsupportedFeature("several sources in an interpreted step")
        src = reads[0]
        df = as_values(self.source(src))
        if step.where is not None:
            df = df.where(X.as_bool(X.to_column(step.where, env_of(df, self)), where=True))
        by = plain(src.by)
        if by:
            from statloom.operators.order import by_flags

            df = by_flags(df, src.by, [RID])
        order = key_order(src.by) + [F.col(RID)]
        df = df.orderBy(*order)
        cols = [c for c in df.columns if c != RID]
        kinds = {c.lower(): "c" if isinstance(f.dataType, T.StringType) else "n" for c, f in ((f.name, f) for f in df.schema) if c in cols and not c.startswith(("first_", "last_"))}
        attrs = {f.name.lower(): {**(f.metadata or {}), "name": f.name} for f in df.schema}
        here = _mentions(step.body, ("put", "callroutine")) or _uses(step.body, HANDLE_NAMES)
        if not here:
            probe = Interpreter(step, kinds, tables, dict(self.macro.vars), self.formats, attrs=attrs)
            return self._in_task(step, df, kinds, tables, by, probe, src, attrs)
        it = Interpreter(step, kinds, tables, self.macro.vars, self.formats, None, self.handles, attrs)
        it.run(_as_rows((r.asDict() for r in df.toLocalIterator()), by, src))
        self.log += it.log
        return {n: self._frame(rows, it) for n, rows in it.out.items()}

    def _in_task(self, step, df, kinds, tables, by, probe, src, attrs):
        names = [probe.names[k] for k in probe.names if not k.startswith("__")]
        kind_of = {k: probe.kinds[k] for k in probe.names}
        targets = list(probe.out)
        schema = ", ".join(["__t string", f"{RID} long"] + [f"`{n}` {'string' if kind_of[n.lower()] == 'c' else 'double'}" for n in names])
        macro, catalog = dict(self.macro.vars), self.formats

        def run(batches):
            import pandas as pd

            def rows():
                for pdf in batches:
                    for rec in pdf.to_dict("records"):
                        yield {k: None if isinstance(v, float) and v != v else v for k, v in rec.items()}

            it = Interpreter(step, kinds, tables, macro, catalog, attrs=attrs)
            made = dict.fromkeys(targets, 0)

            def flush(least: int):
                for t in targets:
                    part = it.out[t]
                    if len(part) > least:
                        at = made[t]
                        made[t] += len(part)
                        it.out[t] = []
                        yield pd.DataFrame({"__t": [t] * len(part), RID: range(at, at + len(part)), **{n: pd.Series([r.get(n) for r in part], dtype=object) for n in names}})

            for _ in it.stream(_as_rows(rows(), by, src)):
                yield from flush(10_000)
            yield from flush(0)

        shown = {n.lower() for n in names}
        if probe.group_local(by) and {k.lower() for k in by} <= shown:
            # Whole groups go to tasks by their key; the order of the groups comes after.
            dealt = df.repartition(*by).sortWithinPartitions(*key_order(src.by), RID).drop(RID).mapInPandas(run, schema)
            return {t: with_rid(dealt.where(F.col("__t") == t).drop("__t").orderBy(*key_order(src.by), RID).drop(RID)) for t in targets}
        # One ordered task: the step may keep values from row to row.
        made = df.drop(RID).coalesce(1).mapInPandas(run, schema)
        return {t: made.where(F.col("__t") == t).drop("__t") for t in targets}

    def _lookups(self, step: Step) -> set[str]:
        names = {s.datasets[0][0] for s in step.sources if "point" in s.options}

        def walk(body):
            for st in body or ():
                if st is None:
                    continue
                if st[0] == "newhash":
                    for a in st[3]:
                        if a[0] == "named" and a[1] == "dataset" and a[2][0] == "str":
                            names.add(a[2][1].strip())
                for x in st:
                    if isinstance(x, list):
                        walk([y for y in x if isinstance(y, tuple) and y and isinstance(y[0], str)])

        walk(step.body)
        return names

    def _frame(self, rows: list[dict], it: Interpreter) -> DataFrame:
        names = [it.names[k] for k in it.names if not k.startswith("__")]
        if rows and not set(rows[0]) >= set(names):
            names = list(rows[0])
        fields = [T.StructField(n, T.StringType() if it.kinds.get(n.lower()) == "c" else T.DoubleType()) for n in names] + [T.StructField(RID, T.LongType())]
        data = [tuple(_typed(r.get(n), it.kinds.get(n.lower())) for n in names) + (k,) for k, r in enumerate(rows)]
        return self.spark.createDataFrame(data, T.StructType(fields))


def _typed(v, kind):
    if kind == "c":
        return v if isinstance(v, str) else ""
    return None if v is None or isinstance(v, str) else float(v)


def _mentions(body, tags) -> bool:
    for st in body or ():
        if isinstance(st, tuple) and st and st[0] in tags:
            return True
        if isinstance(st, tuple) and any(isinstance(x, list) and _mentions(x, tags) for x in st):
            return True
        if isinstance(st, tuple) and any(isinstance(x, list) and any(isinstance(y, tuple) and any(isinstance(z, list) and _mentions(z, tags) for z in y) for y in x) for x in st):
            return True
    return False


def _uses(e, names) -> bool:
    """Whether a function of these names is called anywhere."""
    if isinstance(e, tuple) and len(e) == 3 and e[0] == "call" and isinstance(e[1], str) and e[1].upper() in names:
        return True
    return isinstance(e, (tuple, list)) and any(_uses(x, names) for x in e)


def _as_rows(rows, by, src):
    """Rows with first.x and last.x for the interpreter, and END='s flag."""
    end = src.options.get("end")
    held = None
    for r in rows:
        row = {}
        for k, v in r.items():
            if k == RID:
                continue
            if k.startswith("first_") and k[6:] in by:
                row[f"first.{k[6:].lower()}"] = float(v)
            elif k.startswith("last_") and k[5:] in by:
                row[f"last.{k[5:].lower()}"] = float(v)
            else:
                row[k] = float(v) if isinstance(v, (int, bool)) and v is not None else v
        if held is not None:
            if end:
                held[end] = 0.0
            yield held
        held = row
    if held is not None:
        if end:
            held[end] = 1.0
        yield held


# ---- declarative steps -------------------------------------------------------------------


class NotDeclarative(Exception):
    pass


def env_of(df: DataFrame, session: Session, arrays=None) -> X.Env:
    cols = {}
    for f in df.schema:
        if f.name == RID:
            continue
        char = isinstance(f.dataType, T.StringType)
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DateType):
            from statloom.plans.intervals import sas_date

            c = sas_date(c)
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            from statloom.plans.intervals import sas_datetime

            c = sas_datetime(c)
        elif not char:
            c = c.cast("double")
        cols[f.name.lower()] = (c, "c" if char else "n")
    return X.Env(cols, session.formats, arrays or {})


def as_values(df: DataFrame) -> DataFrame:
    """Native dates, timestamps and numbers of other kinds as the numbers that steps see;
    labels and formats stay. Columns of other types are as they are."""
    from statloom.plans.intervals import sas_date, sas_datetime

    def seen(f):
        c = F.col(f"`{f.name}`")
        if f.name == RID:
            return c
        if isinstance(f.dataType, T.DateType):
            c = sas_date(c)
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = sas_datetime(c)
        elif not isinstance(f.dataType, (T.NumericType, T.BooleanType)):
            return c
        return c.cast("double").alias(f.name, metadata=f.metadata or {})

    return df.select(*map(seen, df.schema))


class Declarative:
    """A step of assignments, conditions, filters and outputs over one source as columns.

    Each statement maps the symbol table to new columns under the condition it stands
    in; a row's fate (kept or not) is a condition, too. FIRST./LAST. and sum statements
    become windows within BY groups."""

    def __init__(self, session: Session, step: Step):
        self.s, self.step = session, step
        self.filters: list = []

    def build(self) -> dict[str, DataFrame]:
        step = self.step
        if len(step.sources) != 1 or step.datalines or step.infile or step.sources[0].options or step.sources[0].notsorted:
            raise NotDeclarative
        if not step.body or step.body[0] != ("read", 0) or step.retain:
            raise NotDeclarative
        if any(a["temp"] or a["init"] for a in step.arrays.values()):
            raise NotDeclarative
        self._simple(step.body[1:])
        src = step.sources[0]
        df = self.s.source(src)
        if step.where is not None:
            df = df.where(X.as_bool(X.to_column(step.where, env_of(df, self.s)), where=True))
        self.by = plain(src.by)
        if src.by:
            from statloom.operators.order import by_flags

            df = by_flags(df, src.by, [RID])
        names = {c.lower() for c in df.columns}
        arrays = {}
        for name, a in step.arrays.items():
            if len(a["bounds"]) > 1 or not a["parts"]:
                raise NotDeclarative
            arrays[name] = [m for p in a["parts"] for m in X.expand_of(p, [c for c in df.columns if c != RID], {})]
            if any(m.lower() not in names for m in arrays[name]):
                raise NotDeclarative
        self.env = env_of(df, self.s, arrays)
        for k in self.by:
            for edge in ("first", "last"):
                self.env.columns[f"{edge}.{k.lower()}"] = self.env.columns.pop(f"{edge}_{k.lower()}")
        self.drop_auto = {f"{e}_{k}".lower() for k in self.by for e in ("first", "last")} | {(o.get("in") or "").lower() for _, o in src.datasets}
        self.shown = {c.lower(): c for c in df.columns if c != RID and c.lower() not in self.drop_auto and not c.startswith("__s")}
        self.alive = F.lit(True)
        self.outputs: list = []
        self.df = df
        self.explicit = _mentions(step.body, ("output",))
        self.order = key_order(src.by) + [F.col(RID)]
        for st in step.body[1:]:
            self.statement(st, F.lit(True))
        if not self.explicit:
            self.outputs.append(([n.lower() for n, _ in step.targets], self.alive, dict(self.env.columns)))
        out = {}
        for name, _ in step.targets:
            mine = [o for o in self.outputs if name.lower() in o[0] or not o[0]]
            frames = []
            for j, (_, cond, cols) in enumerate(mine):
                picked = [self._typed(cols[k], k).alias(v) for k, v in self.shown.items() if k in cols]
                part = self.df.where(cond).select(*picked, F.col(RID), F.lit(j).alias("__j"))
                frames.append(part)
            if not frames:
                raise NotDeclarative
            whole = frames[0]
            for f in frames[1:]:
                whole = whole.unionByName(f, allowMissingColumns=True)
            if self.by:
                whole = whole.withColumn(RID, F.col(RID))
            out[name.lower()] = self._ordered(whole, len(frames) > 1, src)
        return out

    def _ordered(self, df: DataFrame, several: bool, src: Source) -> DataFrame:
        if not src.by:
            return (df.withColumn(RID, F.col(RID) * 64 + F.col("__j")) if several else df).drop("__j")
        # The order of the BY values is the order of the result.
        cols = {c.lower(): c for c in df.columns}
        if any(k.lower() not in cols for k in self.by):
            raise NotDeclarative
        sorted_ = df.orderBy(*key_order(src.by), RID, "__j").drop(RID, "__j")
        return with_rid(sorted_)

    def _typed(self, ck, name):
        c, k = ck
        if k == "b":
            c = c.cast("double")
        if name in self.step.lengths and self.step.lengths[name][0] == "c":
            c = F.substring(c, 1, self.step.lengths[name][1])
        return c

    def _simple(self, body) -> None:
        for st in body:
            tag = st[0]
            if tag in ("assign", "ifsub", "delete", "output", "declare"):
                continue
            if tag == "sum" and self.step.sources[0].by:
                continue
            if tag == "if":
                self._simple(st[2])
                self._simple(st[3] or [])
            elif tag == "block":
                self._simple(st[1])
            elif tag == "select":
                for _, arm in st[2]:
                    self._simple(arm)
                if st[3] is None:
                    raise NotDeclarative
                self._simple(st[3])
            else:
                raise NotDeclarative

    def ev(self, e):
        if _calls(e):
            raise NotDeclarative
        return X.to_column(e, self.env)

    def statement(self, st, cond) -> None:
        tag = st[0]
        if tag == "assign":
            if st[1][0] != "var":
                raise NotDeclarative
            self.assign(st[1][1], self.ev(st[2]), cond)
        elif tag == "declare":
            pass
        elif tag == "ifsub":
            self.alive = self.alive & (X.as_bool(self.ev(st[1])) | ~cond)
        elif tag == "delete":
            self.alive = self.alive & ~cond
        elif tag == "output":
            self.outputs.append((st[1], self.alive & cond, dict(self.env.columns)))
        elif tag == "block":
            for x in st[1]:
                self.statement(x, cond)
        elif tag == "if":
            c = X.as_bool(self.ev(st[1]))
            held = self._hold(c)
            for x in st[2]:
                self.statement(x, cond & held)
            for x in st[3] or []:
                self.statement(x, cond & ~held)
        elif tag == "select":
            done = F.lit(False)
            for conds, arm in st[2]:
                hit = F.lit(False)
                for c in conds:
                    hit = hit | (X.compare_columns("=", self.ev(st[1]), self.ev(c)) if st[1] is not None else X.as_bool(self.ev(c)))
                here = self._hold(hit & ~done)
                for x in arm:
                    self.statement(x, cond & here)
                done = done | here
            for x in st[3]:
                self.statement(x, cond & ~done)
        elif tag == "sum":
            self.sum_(st, cond)
        else:
            raise NotDeclarative

    def _hold(self, c):
        """A condition as it is now, though its variables change later."""
        return c

    def assign(self, name: str, value, cond) -> None:
        key = name.lower()
        kind = "n" if value[1] == "b" else value[1]
        if key in self.env.columns:
            old = self.env.columns[key]
            kind = old[1]
        else:
            if key in self.step.lengths:
                kind = self.step.lengths[key][0]
            old = (F.lit("") if kind == "c" else F.lit(None).cast("double"), kind)
            self.shown[key] = self.step.lengths[key][2] if key in self.step.lengths else name
        new = X.as_char(value) if kind == "c" else X.as_num(value)
        if kind == "c" and value[1] != "c":
            new = F.trim(new)
        if key in self.step.lengths and kind == "c":
            new = F.substring(new, 1, self.step.lengths[key][1])
        self.env.columns[key] = (F.when(cond, new).otherwise(old[0]), kind)

    def sum_(self, st, cond) -> None:
        """v + e with FIRST.: a running total that starts anew where it is set to a
        constant under FIRST.k; anything else is for the interpreter."""
        raise NotDeclarative


def _calls(e) -> bool:
    """Whether an expression has a function that depends on the rows before it."""
    if not isinstance(e, tuple):
        return False
    if e[0] == "call" and (re.fullmatch(r"(lag|dif)\d*", e[1].lower()) or e[1].lower() in ("rand", "ranuni", "rannor", "uniform", "normal", "ranexp", "symget", "resolve") or e[1].upper() in HANDLE_NAMES or re.match(r"v(in)?(format|label|length|type|name|value)", e[1].lower())):
        return True
    if e[0] == "var" and e[1].lower() in ("_n_", "_error_"):
        return True
    return any(_calls(x) if isinstance(x, tuple) else any(_calls(y) for y in x) if isinstance(x, list) else False for x in e[1:])


# ---- options and attributes --------------------------------------------------------------


def expand_names(parts, columns: list[str]) -> list[str]:
    out = []
    for p in parts:
        if p[0] == "name" and p[1].lower() in ("_all_", "_numeric_", "_character_"):
            out += columns
        else:
            out += X.expand_of(p, columns, {})
    return out


def dataset_options(df: DataFrame, opts: dict, keep_order: bool = False) -> DataFrame:
    """WHERE, then the slice, then KEEP and DROP, then RENAME."""
    if "where" in opts:
        env = X.Env({f.name.lower(): (F.col(f"`{f.name}`").cast("double") if not isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`"), "c" if isinstance(f.dataType, T.StringType) else "n") for f in df.schema if f.name != RID})
        df = df.where(X.as_bool(X.to_column(opts["where"], env), where=True))
    first = int(opts.get("firstobs", 1))
    last = None if str(opts.get("obs", "max")).lower() == "max" else int(opts["obs"])
    if first > 1 or last is not None:
        from statloom.operators.order import slice_rows

        df = slice_rows(with_rid(df), [RID], first, last)
    cols = [c for c in df.columns if c != RID]
    if "keep" in opts:
        want = {n.lower() for n in expand_names(opts["keep"], cols)}
        cols = [c for c in cols if c.lower() in want]
    if "drop" in opts:
        gone = {n.lower() for n in expand_names(opts["drop"], cols)}
        cols = [c for c in cols if c.lower() not in gone]
    ren = opts.get("rename", {})
    return df.select(*[F.col(f"`{c}`").alias(ren.get(c.lower(), c)) for c in cols], *([RID] if RID in df.columns else []))


def finish(df: DataFrame, step: Step) -> DataFrame:
    """KEEP, DROP, RENAME and attributes of the step."""
    cols = [c for c in df.columns if c != RID and not c.lower().startswith(("first.", "last."))]
    auto = {s.options.get(k, "").lower() for s in step.sources for k in ("point", "nobs", "end")} | {(o.get("in") or "").lower() for s in step.sources for _, o in s.datasets}
    cols = [c for c in cols if c.lower() not in auto and not c.startswith("__") and c.lower() != "_i_"]
    if step.keep is not None:
        want = {n.lower() for n in expand_names(step.keep, cols)}
        cols = [c for c in cols if c.lower() in want]
    if step.drop is not None:
        gone = {n.lower() for n in expand_names(step.drop, cols)}
        cols = [c for c in cols if c.lower() not in gone]
    out = []
    for c in cols:
        meta = dict(df.schema[c].metadata or {})
        key = c.lower()
        if key in step.formats:
            meta["format"] = step.formats[key]
        if key in step.labels:
            meta["label"] = step.labels[key]
        if key in step.lengths:
            meta["len"] = step.lengths[key][1]
        out.append(F.col(f"`{c}`").alias(step.rename.get(key, c), metadata=meta))
    return df.select(*out, *([RID] if RID in df.columns else []))
