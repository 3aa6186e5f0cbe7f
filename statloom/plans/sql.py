"""PROC SQL: statements parsed and planned as DataFrames.

Missing is the least value and equal to itself, aggregates beside detail columns are
remerged, set operations match by position or by name, and CALCULATED refers to the
select list."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statloom.formats import UnsupportedFeature
from statloom.operators import shape
from statloom.operators.order import RID
from statloom.plans import expr as X
from statloom.plans.lexer import ProgramError, Token, statements, tokenize
from statloom.plans.step import dataset_list

AGGREGATES = {"count": "n", "freq": "n", "n": "n", "nmiss": "nmiss", "sum": "sum", "avg": "mean", "mean": "mean", "min": "min", "max": "max", "std": "std", "var": "var", "stderr": "stderr", "range": "range", "uss": "uss", "css": "css", "cv": "cv", "sumwgt": "sumwgt", "t": "t", "prt": "prt"}


@dataclass
class Query:
    items: list = field(default_factory=list)  # (expr, alias, attributes)
    distinct: bool = False
    tables: list = field(default_factory=list)  # (how, ref, alias, on)
    where: object = None
    group: list = field(default_factory=list)
    having: object = None
    order: list = field(default_factory=list)  # (expr, descending)
    into: list = field(default_factory=list)


class SqlParser(X.Parser):
    def __init__(self, tokens: list[Token]):
        super().__init__(tokens, sql=True, subquery=lambda p: p.query())

    def query(self):
        """A query expression: SELECTs joined by set operators, then ORDER BY."""
        left = self._intersect()
        while (p := self.peek()) and p.is_("union", "except", "outer"):
            kind = self.take().text.lower()
            if kind == "outer":
                self.expect("union")
                kind = "outer union"
            mods = set()
            while m := self.accept("all", "corr", "corresponding"):
                mods.add("corr" if m.text.lower().startswith("corr") else "all")
            left = ("set", kind, left, self._intersect(), "all" in mods, "corr" in mods)
        if self.accept("order"):
            self.expect("by")
            order = self._order()
            if isinstance(left, Query):
                left.order = order
            else:
                left = ("ordered", left, order)
        return left

    def _intersect(self):
        left = self._select()
        while self.accept("intersect"):
            mods = set()
            while m := self.accept("all", "corr", "corresponding"):
                mods.add("corr" if m.text.lower().startswith("corr") else "all")
            left = ("set", "intersect", left, self._select(), "all" in mods, "corr" in mods)
        return left

    def _select(self):
        if self.accept("("):
            q = self.query()
            self.expect(")")
            return q
        self.expect("select")
        q = Query()
        q.distinct = bool(self.accept("distinct", "unique"))
        while True:
            q.items.append(self._item())
            if not self.accept(","):
                break
        if self.accept("into"):
            q.into = self._into()
        if self.accept("from"):
            q.tables = self._from()
        if self.accept("where"):
            q.where = self.parse()
        if self.accept("group"):
            self.expect("by")
            while True:
                q.group.append(self.parse())
                if not self.accept(","):
                    break
        if self.accept("having"):
            q.having = self.parse()
        return q

    def _order(self):
        out = []
        while True:
            e = self.parse()
            down = bool(self.accept("desc", "descending"))
            self.accept("asc", "ascending")
            out.append((e, down))
            if not self.accept(","):
                return out

    def _item(self):
        if self.accept("*"):
            return (("star",), None, {})
        e = self.parse()
        alias, attrs = None, {}
        if self.accept("as"):
            alias = self.take().text
        while (p := self.peek()) and p.kind == "name" and p.text.lower() in ("label", "format", "informat", "length"):
            key = self.take().text.lower()
            self.expect("=")
            if (t := self.peek()).kind in ("string",):
                attrs[key] = self.take().value
            else:
                text, end = "", t.at
                while (t := self.peek()) and t.at == end and not t.is_(",", "from"):
                    text += self.take().text
                    end = t.end
                attrs[key] = text
        if alias is None and (p := self.peek()) and p.kind == "name" and p.text.lower() not in RESERVED:
            alias = self.take().text
        return (e, alias, attrs)

    def _into(self):
        out = []
        while self.accept(":"):
            name = self.take().text
            item = {"name": name}
            if self.accept("-"):
                item["range"] = self.take().text if self.accept(":") else ""
            if self.accept("separated"):
                self.expect("by")
                item["sep"] = self.take().value
            while self.accept("trimmed", "notrim"):
                item["trim"] = True
            out.append(item)
            if not self.accept(","):
                break
        return out

    def _from(self):
        out = [("from", *self._ref(), None)]
        while True:
            if self.accept(","):
                out.append(("comma", *self._ref(), None))
                continue
            how = None
            if self.accept("inner"):
                how = "inner"
            elif w := self.accept("left", "right", "full"):
                how = w.text.lower()
                self.accept("outer")
            elif self.accept("cross"):
                how = "cross"
            elif self.accept("natural"):
                raise UnsupportedFeature("NATURAL JOIN")
            if how or (self.peek() and self.peek().is_("join")):
                self.expect("join")
                ref = self._ref()
                on = None
                if self.accept("on"):
                    on = self.parse()
                out.append((how or "inner", *ref, on))
                continue
            return out

    def _ref(self):
        if self.accept("("):
            q = self.query()
            self.expect(")")
            self.accept("as")
            alias = self.take().text if self.peek() and self.peek().kind == "name" and self.peek().text.lower() not in RESERVED else None
            return (q, alias)
        name = self.take().text
        if self.accept("."):
            name += "." + self.take().text
        opts = {}
        if (p := self.peek()) and p.is_("("):
            start = self.k
            depth = 0
            while True:
                t = self.take()
                depth += t.is_("(") - t.is_(")")
                if not depth:
                    break
            opts = dataset_list("x " + " ".join(t.text for t in self.t[start : self.k]))[0][1]
        self.accept("as")
        alias = None
        if (p := self.peek()) and p.kind == "name" and p.text.lower() not in RESERVED:
            alias = self.take().text
        return ((name, opts), alias or name.split(".")[-1])


RESERVED = {"from", "where", "group", "having", "order", "on", "inner", "left", "right", "full", "cross", "join", "union", "except", "intersect", "outer", "as", "into", "set", "natural", "desc", "asc", "descending", "then", "else", "end", "when", "and", "or", "separated", "values", "corr", "all"}


class Scope:
    """Columns by qualified and plain name, and an outer scope for correlated queries."""

    def __init__(self):
        self.by_name: dict[str, list[tuple]] = {}
        self.order: list[tuple[str, str, str]] = []  # (alias, name, inner column)
        self.kinds: dict[str, str] = {}
        self.meta: dict[str, dict] = {}

    def add(self, alias, name, inner, kind, meta):
        self.by_name.setdefault(name.lower(), []).append((alias.lower() if alias else None, inner))
        self.order.append((alias, name, inner))
        self.kinds[inner] = kind
        self.meta[inner] = meta

    def find(self, name, alias=None):
        for a, inner in self.by_name.get(name.lower(), []):
            if alias is None or a == alias.lower():
                return inner
        return None


class Planner:
    def __init__(self, session):
        self.s, self.n = session, 0
        self.plain_limit = None

    # -- queries

    def run(self, q, outer=None) -> DataFrame:
        if isinstance(q, tuple) and q[0] == "set":
            a, b = self.run(q[2], outer), self.run(q[3], outer)
            if not q[5] and q[1] != "outer union":
                b = b.toDF(*a.columns[: len(b.columns)]) if len(a.columns) == len(b.columns) else b
            return shape.set_operation(q[1], a, b, q[4], q[5])
        if isinstance(q, tuple) and q[0] == "ordered":
            df = self.run(q[1], outer)
            keys = [(df.columns[int(e[1]) - 1] if e[0] == "num" else e[1], d) for e, d in q[2]]
            return df.orderBy(*[F.col(k).desc_nulls_last() if d else F.col(k).asc_nulls_first() for k, d in keys])
        return self.select(q, outer)[0]

    def frame(self, ref) -> DataFrame:
        if isinstance(ref, tuple) and ref[0] in ("set", "ordered") or isinstance(ref, Query):
            return self.run(ref)
        from statloom.session import dataset_options

        name, opts = ref
        df = self.s.table(name)
        if self.s.options.get("inobs"):
            df = df.limit(int(self.s.options["inobs"]))
        return dataset_options(df, opts, keep_order=True)

    def tag(self, df: DataFrame, alias: str, scope: Scope) -> DataFrame:
        """Columns under names of their own, so that joins are never ambiguous."""
        self.n += 1
        out = []
        for f in df.schema:
            inner = f"q{self.n}_{f.name}"
            c = F.col(f"`{f.name}`")
            if f.name == RID:
                out.append(c.alias(inner))
                scope.rids = [*getattr(scope, "rids", []), inner]
                continue
            char = isinstance(f.dataType, T.StringType)
            if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
                from statloom.plans.intervals import sas_date, sas_datetime

                c = sas_date(c) if isinstance(f.dataType, T.DateType) else sas_datetime(c)
            out.append((c if char else c.cast("double")).alias(inner))
            scope.add(alias, f.name, inner, "c" if char else "n", dict(f.metadata or {}))
        return df.select(*out)

    def select(self, q: Query, outer=None):
        scope = Scope()
        df = None
        aliases = {a.lower(): e for e, a, _ in q.items if a}
        pending = _conjuncts(_calculated(q.where, aliases) if q.where is not None else None)
        for how, ref, alias, on in q.tables:
            side = Scope()
            right = self.tag(self.frame(ref), alias, side)
            for a, n, i in side.order:
                scope.add(a, n, i, side.kinds[i], side.meta[i])
            scope.rids = [*getattr(scope, "rids", []), *getattr(side, "rids", [])]
            if df is None:
                df = right
            elif how == "comma":
                # Conditions on both sides become the join's, so none is a product that
                # the WHERE narrows down afterwards.
                use = [c for c in pending if _plain(c) and self._bound(c, scope) and not self._bound_in(c, df.columns, scope)]
                pending = [c for c in pending if c not in use]
                cond = self._join_condition(use, scope, outer)
                df = df.crossJoin(right) if cond is None else df.join(right, cond, "inner")
            elif how == "cross":
                df = df.crossJoin(right)
            else:
                df = df.join(right, X.as_bool(X.to_column(on, self.env(scope, outer)), where=True), {"full": "full", "left": "left", "right": "right", "inner": "inner"}[how])
        if df is None:
            df = self.s.spark.range(1).select(F.lit(1).alias("q0_one"))
        for c in pending:
            df = self._filter(df, c, scope, outer)
        items = []
        for e, a, attrs in q.items:
            if e[0] == "star" or e[0] == "dot" and e[2] == "*":
                want = e[1].lower() if e[0] == "dot" else None
                seen = set()
                for al, name, inner in scope.order:
                    if (want is None or al.lower() == want) and name.lower() not in seen:
                        seen.add(name.lower())
                        items.append((("inner", inner), name, {}))
            else:
                items.append((e, a, attrs))
        named = []
        for k, (e, a, attrs) in enumerate(items, 1):
            name = a or (e[1] if e[0] == "var" else e[2] if e[0] == "dot" else f"_col{k}")
            named.append((e, name, attrs))
        group = [self._group_item(g, named, aliases) for g in q.group]
        having = q.having
        has_agg = any(_aggregates(e, aliases) for e, _, _ in named) or having is not None and _aggregates(having, aliases)
        subst = lambda e: _calculated(e, aliases)
        named = [(subst(e), n, at) for e, n, at in named]
        having = subst(having) if having is not None else None
        order = [(subst(self._order_item(e, named, aliases, scope)), d) for e, d in q.order]
        env = self.env(scope, outer)
        if not (has_agg or group):
            for k, (e, n, at) in enumerate(named):
                df, e = self.attach(df, e, scope)
                named[k] = (e, n, at)
        if not has_agg and not group:
            if having is not None:
                df = self._filter(df, having, scope, outer)
            out = self._project(df, named, order, env, scope, q.distinct)
        else:
            detail = any(not _functional(e, group) for e, _, _ in named) or having is not None and not _functional(having, group) or any(not _functional(e, group) for e, _ in order)
            aggs: dict = {}
            repl = lambda e: _replace_aggregates(e, aggs)
            named2 = [(repl(e), n, at) for e, n, at in named]
            having2 = repl(having) if having is not None else None
            order2 = [(repl(e), d) for e, d in order]
            made = [(*self._aggregate(a, env), name) for a, name in aggs.items()]
            keys = []
            for k, g in enumerate(group):
                c, kind = X.to_column(g, env)
                keys.append((c.cast("double") if kind == "b" else c, f"g{k}", g, "n" if kind == "b" else kind))
            if detail:
                w = Window.partitionBy(*[c for c, *_ in keys])
                for c, _, name in made:
                    df = df.withColumn(name, c.over(w))
            else:
                df = df.groupBy(*[c.alias(n) for c, n, *_ in keys]).agg(*[c.alias(name) for c, _, name in made] or [F.count("*").alias("__n")])
            env2 = self.env(scope, outer, aggs={name: kind for _, kind, name in made}, keys=None if detail else {repr(g): (n, k) for _, n, g, k in keys})
            if having2 is not None:
                df, having2 = self.attach(df, having2, scope)
                df = df.where(X.as_bool(X.to_column(having2, env2), where=True))
            for k, (e, n, at) in enumerate(named2):
                df, e = self.attach(df, e, scope)
                named2[k] = (e, n, at)
            out = self._project(df, named2, order2, env2, scope, q.distinct)
        return out, scope

    def _project(self, df, named, order, env, scope, distinct):
        cols, sorts = [], []
        for e, name, attrs in named:
            c, kind = X.to_column(e, env)
            meta = dict(scope.meta.get(e[1], {})) if e[0] == "inner" else dict(scope.meta.get(scope.find(e[1]) or "", {})) if e[0] == "var" else {}
            meta |= {"len" if k == "length" else k: v for k, v in attrs.items()}
            cols.append((c.cast("double") if kind == "b" else c).alias(name, metadata=meta))
        names = {n.lower() for _, n, _ in named}
        if len(names) < len(named):
            seen, unique = set(), []
            for c, (_, n, _) in zip(cols, named):
                if n.lower() not in seen:
                    seen.add(n.lower())
                    unique.append(c)
            cols = unique
        if distinct:
            out = df.select(*cols).distinct()
            by_name = {repr(e): n for e, n, _ in named}
            keys = [(F.col(by_name[repr(e)]), d) for e, d in order if repr(e) in by_name]
            return out.orderBy(*[c.desc_nulls_last() if d else c.asc_nulls_first() for c, d in keys]) if keys else out
        for e, d in order:
            c, kind = X.to_column(e, env)
            sorts.append(c.desc_nulls_last() if d else c.asc_nulls_first())
        if sorts:
            df = df.orderBy(*sorts)
        out = df.select(*cols)
        return out

    def _group_item(self, g, named, aliases):
        if g[0] == "num":
            return named[int(g[1]) - 1][0]
        if g[0] == "var" and g[1].lower() in aliases:
            return aliases[g[1].lower()]
        return _calculated(g, aliases)

    def _order_item(self, e, named, aliases, scope):
        if e[0] == "num":
            return named[int(e[1]) - 1][0]
        if e[0] == "var" and e[1].lower() in aliases:
            return aliases[e[1].lower()]
        return e

    # -- names and predicates

    def env(self, scope: Scope, outer=None, aggs=None, keys=None) -> X.Env:
        env = X.Env(catalog=self.s.formats)

        def special(e):
            if keys is not None and repr(e) in keys:
                n, kind = keys[repr(e)]
                return F.col(n), kind
            tag = e[0]
            if tag == "agg":
                return F.col(e[1]), aggs[e[1]]
            if tag == "inner":
                return F.col(e[1]), scope.kinds[e[1]]
            if tag == "var":
                inner = scope.find(e[1])
                if inner:
                    return F.col(inner), scope.kinds[inner]
                if outer is not None and (i := outer.find(e[1])):
                    return F.col(i), outer.kinds[i]
                raise ProgramError(f"column {e[1]} is not found")
            if tag == "dot":
                inner = scope.find(e[2], e[1])
                if inner:
                    return F.col(inner), scope.kinds[inner]
                if outer is not None and (i := outer.find(e[2], e[1])):
                    return F.col(i), outer.kinds[i]
                raise ProgramError(f"column {e[1]}.{e[2]} is not found")
            if tag == "call" and e[1].lower() == "monotonic":
                rids = getattr(scope, "rids", [])
                return F.row_number().over(Window.orderBy(*rids)).cast("double") if rids else F.monotonically_increasing_id().cast("double") + 1, "n"
            if tag == "call" and re.fullmatch(r"(lag|dif)\d*", e[1].lower()):
                raise ProgramError(f"{e[1]} has no meaning in SQL")
            if tag == "ready":
                return e[1], e[2]
            if tag in ("scalar", "exists", "quantified"):
                raise UnsupportedFeature(f"{tag} subquery here")
            return None

        env.special = special
        return env

    # -- subqueries: joins, never a query per row

    def inner(self, q, scope):
        """(frame, scope, conditions) of a subquery's FROM and WHERE: the conditions that
        name columns of the query around are left for the join."""
        if not isinstance(q, Query):
            own = Scope()
            return self.tag(self.run(q), "sub", own), own, []
        own, df = Scope(), None
        conds = _conjuncts(q.where)
        for how, ref, alias, on in q.tables:
            side = Scope()
            right = self.tag(self.frame(ref), alias, side)
            for a, n, i in side.order:
                own.add(a, n, i, side.kinds[i], side.meta[i])
            if df is None:
                df = right
            elif how == "comma":
                use = [c for c in conds if _plain(c) and self._bound(c, own) and not self._bound_in(c, df.columns, own)]
                conds = [c for c in conds if c not in use]
                cond = self._join_condition(use, own, None)
                df = df.crossJoin(right) if cond is None else df.join(right, cond, "inner")
            elif how == "cross":
                df = df.crossJoin(right)
            else:
                df = df.join(right, X.as_bool(X.to_column(on, self.env(own)), where=True), how)
        late = []
        for c in conds:
            if _plain(c) and not self._bound(c, own):
                late.append(c)
            else:
                df = self._filter(df, c, own, None)
        return df, own, late

    def _semi(self, df, q, scope, test, how):
        """EXISTS and IN as a semi or anti join; ``test`` makes a condition of the
        subquery's one column."""
        if isinstance(q, Query) and not any(_aggregates(e, {}) for e, _, _ in q.items) and not q.group:
            sub, own, late = self.inner(q, scope)
            cond = None
            for c in late:
                b = X.as_bool(X.to_column(c, self.env(own, scope)), where=True)
                cond = b if cond is None else cond & b
            if test is not None:
                e = q.items[0][0]
                b = test(X.to_column(("inner", own.order[0][2]) if e[0] == "star" else e, self.env(own, scope)))
                cond = b if cond is None else cond & b
            if cond is None:
                cond = F.lit(True)
                sub = sub.limit(1)
            return df.join(sub, cond, how)
        sub = self.run(q)
        own = Scope()
        sub = self.tag(sub, "sub", own)
        inner = own.order[0][2]
        cond = test((F.col(inner), own.kinds[inner])) if test is not None else F.lit(True)
        return df.join(sub, cond, how)

    def attach(self, df, e, scope):
        """The frame with a column for each scalar, EXISTS or quantified subquery in the
        expression, and the expression on those columns."""
        if isinstance(e, list):
            out = []
            for x in e:
                df, y = self.attach(df, x, scope)
                out.append(y)
            return df, out
        if not isinstance(e, tuple) or not e or _plain(e):
            return df, e
        if e[0] == "scalar":
            return self._scalar(df, e[1], scope)
        if e[0] == "exists" or e[0] == "in" and isinstance(e[2], tuple) and e[2][0] == "subquery":
            self.n += 1
            mark, rid = f"m{self.n}", f"r{self.n}"
            base = df.withColumn(rid, F.monotonically_increasing_id())
            hit = self._filter(base, e if e[0] == "exists" else ("in", e[1], e[2], False), scope, None).select(F.col(rid).alias(f"{rid}_k"), F.lit(True).alias(mark))
            df = base.join(hit, F.col(rid) == F.col(f"{rid}_k"), "left")
            found = F.coalesce(F.col(mark), F.lit(False))
            return df, ("ready", ~found if e[0] == "in" and e[3] else found, "b")
        if e[0] == "quantified":
            return self._quantified(df, e, scope)
        out = []
        for x in e:
            if isinstance(x, (tuple, list)):
                df, x = self.attach(df, x, scope)
            out.append(x)
        return df, tuple(out)

    def _scalar(self, df, q, scope):
        """One value per row of the query around: the subquery's aggregate by its
        correlated columns, or its first row."""
        sub, own, late = self.inner(q, scope)
        e = _calculated(q.items[0][0], {}) if isinstance(q, Query) else ("inner", own.order[0][2])
        self.n += 1
        name = f"v{self.n}"
        keys, pairs = [], []
        for k, c in enumerate(late):
            sides = [x for x in (c[2], c[3]) if c[0] == "cmp" and c[1] == "="] if c[0] == "cmp" else []
            mine = [x for x in sides if self._bound(x, own)]
            theirs = [x for x in sides if x not in mine]
            if len(mine) != 1 or len(theirs) != 1:
                raise UnsupportedFeature("a scalar subquery correlated by other than equality")
            a, b = X.to_column(mine[0], self.env(own)), X.to_column(theirs[0], self.env(scope))
            left, right = (F.rtrim(a[0]), F.rtrim(b[0])) if a[1] == b[1] == "c" else (X.as_num(a), X.as_num(b))
            keys.append(left.alias(f"{name}_k{k}"))
            pairs.append((f"{name}_k{k}", right))
        counts = False
        if _aggregates(e, {}):
            aggs: dict = {}
            made = _replace_aggregates(e, aggs)
            cols = [(*self._aggregate(a, self.env(own)), n) for a, n in aggs.items()]
            counts = e[0] == "call" and e[1].lower() in ("count", "n", "freq", "nmiss")
            one = sub.groupBy(*keys).agg(*[c.alias(f"{name}_{n}") for c, _, n in cols])
            env = self.env(own)
            inner_special = env.special
            env.special = lambda x: (F.col(f"{name}_{x[1]}"), dict((n, k) for _, k, n in cols)[x[1]]) if x[0] == "agg" else inner_special(x)
            c, kind = X.to_column(made, env)
            one = one.select(*[k for k, _ in pairs], c.alias(name))
        else:
            c, kind = X.to_column(e, self.env(own))
            one = sub.groupBy(*keys).agg(F.first(c).alias(name))
        if not pairs:
            joined = df.join(F.broadcast(one.limit(1)), F.lit(True), "left")  # one row
        else:
            cond = None
            for k, right in pairs:
                b = right.eqNullSafe(F.col(k))
                cond = b if cond is None else cond & b
            joined = df.join(one, cond, "left")
        value = F.coalesce(F.col(name), F.lit(0.0)) if counts else F.col(name)
        return joined, ("ready", value, "n" if kind == "b" else kind)

    def _quantified(self, df, e, scope):
        """op ANY and op ALL by the least and greatest of the subquery's values."""
        op, q, which = e[1], e[3], e[4]
        sub, own, late = self.inner(q, scope)
        if late:
            raise UnsupportedFeature("a correlated ANY or ALL")
        y, kind = X.to_column(q.items[0][0], self.env(own))
        self.n += 1
        n = f"v{self.n}"
        ends = sub.agg(F.min(y).alias(f"{n}_lo"), F.max(y).alias(f"{n}_hi"), F.count("*").alias(f"{n}_n"), F.count_if(y.isNull()).alias(f"{n}_m"), F.count_distinct(y).alias(f"{n}_d"))
        df = df.crossJoin(F.broadcast(ends))  # one row
        x = X.to_column(e[2], self.env(scope))
        lo = (F.when(F.col(f"{n}_m") > 0, F.lit(None)).otherwise(F.col(f"{n}_lo")), kind)
        hi = (F.col(f"{n}_hi"), kind)
        if op in ("=", "^="):
            if (op == "=") == (which == "any"):
                raise UnsupportedFeature("= ANY or ^= ALL; use IN or NOT IN")
            same = (F.col(f"{n}_d") == 1) & X.compare_columns("=", x, hi)
            test = same if op == "=" else ~same
        else:
            edge = {("<", "any"): hi, ("<", "all"): lo, (">", "any"): lo, (">", "all"): hi}[(op[0], which)]
            test = X.compare_columns(op, x, edge)
        return df, ("ready", F.when(F.col(f"{n}_n") == 0, F.lit(which == "all")).otherwise(test), "b")

    def _filter(self, df, cond, scope, outer):
        neg = cond[0] == "un" and cond[1] == "^"
        e = cond[2] if neg else cond
        if e[0] == "exists":
            return self._semi(df, e[1], scope, None, "left_anti" if neg else "left_semi")
        if e[0] == "in" and isinstance(e[2], tuple) and e[2][0] == "subquery":
            # Missing equals missing, and a missing one in the list doesn't void NOT IN.
            df, x = self.attach(df, e[1], scope)
            value = X.to_column(x, self.env(scope, outer))

            def test(y):
                if value[1] == y[1] == "c":
                    return F.rtrim(value[0]).eqNullSafe(F.rtrim(y[0]))
                return X.as_num(value).eqNullSafe(X.as_num(y))

            return self._semi(df, e[2][1], scope, test, "left_anti" if e[3] != neg else "left_semi")
        df, cond = self.attach(df, cond, scope)
        return df.where(X.as_bool(X.to_column(cond, self.env(scope, outer)), where=True))

    def _join_condition(self, conds, scope, outer):
        out = None
        for c in conds:
            b = X.as_bool(X.to_column(c, self.env(scope, outer)), where=True)
            out = b if out is None else out & b
        return out

    def _refs(self, e, scope):
        if not isinstance(e, tuple):
            return [r for x in e for r in self._refs(x, scope)] if isinstance(e, list) else []
        if e[0] == "var":
            return [scope.find(e[1])]
        if e[0] == "dot":
            return [scope.find(e[2], e[1])]
        return [r for x in e[1:] if isinstance(x, (tuple, list)) for r in self._refs(x, scope)]

    def _bound(self, e, scope):
        return all(r is not None for r in self._refs(e, scope))

    def _bound_in(self, e, columns, scope):
        return all(r in columns for r in self._refs(e, scope))

    def _aggregate(self, e, env):
        """(column, kind) of an aggregate call."""
        name, args = e[1].lower(), e[2]
        if name in ("count", "n", "freq") and (not args or args[0][0] == "star"):
            return F.count("*").cast("double"), "n"
        a = args[0]
        distinct = a[0] == "distinct"
        c, kind = X.to_column(a[1] if distinct else a, env)
        if kind == "b":
            c, kind = c.cast("double"), "n"
        c = F.when(F.rtrim(c) != "", c) if kind == "c" else c
        if name in ("count", "n", "freq"):
            return (F.count_distinct(c) if distinct else F.count(c)).cast("double"), "n"
        if name == "nmiss":
            return F.count_if(c.isNull()).cast("double"), "n"
        if name in ("min", "max"):
            return (F.min if name == "min" else F.max)(c), kind
        if distinct:
            if name in ("sum", "avg", "mean"):
                return (F.sum_distinct(c) if name == "sum" else F.sum_distinct(c) / F.count_distinct(c)), "n"
            raise UnsupportedFeature(f"{name} distinct")
        x = X.as_num((c, kind))
        simple = {"sum": F.sum(x), "avg": F.avg(x), "mean": F.avg(x), "std": F.stddev_samp(x), "var": F.var_samp(x), "range": F.max(x) - F.min(x), "uss": F.sum(x * x), "css": F.var_pop(x) * F.count(x), "stderr": F.stddev_samp(x) / F.sqrt(F.count(x)), "cv": F.try_divide(100 * F.stddev_samp(x), F.avg(x)), "sumwgt": F.count(x).cast("double"), "t": F.try_divide(F.avg(x), F.stddev_samp(x) / F.sqrt(F.count(x)))}
        if name not in simple:
            raise UnsupportedFeature(f"aggregate {name}")
        return simple[name], "n"


def _conjuncts(e):
    if e is None:
        return []
    if e[0] == "bin" and e[1] == "&":
        return _conjuncts(e[2]) + _conjuncts(e[3])
    return [e]


def _plain(e) -> bool:
    if isinstance(e, list):
        return all(_plain(x) for x in e)
    if not isinstance(e, tuple):
        return not isinstance(e, Query)
    return e[0] not in ("scalar", "exists", "subquery", "quantified") and all(_plain(x) for x in e[1:])


def _is_aggregate(e) -> bool:
    return e[0] == "call" and e[1].lower() in AGGREGATES and len(e[2]) <= 1


def _aggregates(e, aliases) -> bool:
    if isinstance(e, list):
        return any(_aggregates(x, aliases) for x in e)
    if not isinstance(e, tuple) or not e:
        return False
    if _is_aggregate(e):
        return True
    if e[0] == "calculated":
        return _aggregates(aliases.get(e[1].lower(), ("num", 0)), aliases)
    if e[0] in ("scalar", "exists", "subquery"):
        return False
    return any(_aggregates(x, aliases) for x in e[1:])


def _functional(e, group) -> bool:
    """Whether an expression depends on the group alone."""
    if isinstance(e, list):
        return all(_functional(x, group) for x in e)
    if not isinstance(e, tuple) or not e:
        return True
    if any(repr(e) == repr(g) for g in group):
        return True
    if _is_aggregate(e):
        return True
    if e[0] in ("scalar", "exists", "subquery"):
        return True
    if e[0] in ("var", "dot", "inner"):
        name = e[1] if e[0] == "var" else e[2] if e[0] == "dot" else re.sub(r"^q\d+_", "", e[1])
        return any(g[0] in ("var", "dot") and (g[1] if g[0] == "var" else g[2]).lower() == name.lower() for g in group)
    return all(_functional(x, group) for x in e[1:])


def _replace_aggregates(e, aggs):
    if isinstance(e, list):
        return [_replace_aggregates(x, aggs) for x in e]
    if not isinstance(e, tuple) or not e:
        return e
    if _is_aggregate(e):
        key = _Key(e)
        if key not in aggs:
            aggs[key] = f"a{len(aggs)}"
        return ("agg", aggs[key])
    if e[0] in ("scalar", "exists", "subquery"):
        return e
    return tuple(_replace_aggregates(x, aggs) for x in e)


class _Key(tuple):
    def __new__(cls, e):
        return super().__new__(cls, e)

    def __hash__(self):
        return hash(repr(tuple(self)))

    def __eq__(self, other):
        return repr(tuple(self)) == repr(tuple(other))


def _calculated(e, aliases):
    if isinstance(e, list):
        return [_calculated(x, aliases) for x in e]
    if not isinstance(e, tuple) or not e:
        return e
    if e[0] == "calculated":
        if e[1].lower() not in aliases:
            raise ProgramError(f"calculated {e[1]} is not in the select list")
        return _calculated(aliases[e[1].lower()], aliases)
    return tuple(_calculated(x, aliases) for x in e)


# ---- statements ------------------------------------------------------------------------------


def run_sql(session, text: str) -> None:
    """The statements of a PROC SQL step, after its first."""
    parts = statements(text)
    noprint = "noprint" in parts[0].lower()
    opts = {k.lower(): int(v) for k, v in re.findall(r"\b(inobs|outobs)\s*=\s*(\d+)", parts[0], re.I)}
    for s in parts[1:]:
        low = s.lower()
        planner = Planner(session)
        session.options["inobs"] = opts.get("inobs")
        try:
            if low.startswith("reset"):
                noprint = "noprint" in low or noprint and "print" not in low.split()
                opts |= {k.lower(): int(v) for k, v in re.findall(r"\b(inobs|outobs)\s*=\s*(\d+)", s, re.I)}
            elif low.startswith(("select", "(")):
                _select(session, planner, s, noprint, opts)
            elif m := re.match(r"create\s+table\s+([\w.]+)\s+as\s+(.*)$", s, re.I | re.S):
                p = SqlParser(tokenize(m[2]))
                df = planner.run(p.query())
                if opts.get("outobs"):
                    df = df.limit(opts["outobs"])
                session.store(m[1], df)
                session.macro.vars["sqlobs"] = str(session.table(m[1]).count())
            elif m := re.match(r"create\s+table\s+([\w.]+)\s+like\s+([\w.]+)$", s, re.I):
                session.store(m[1], session.table(m[2]).limit(0))
            elif m := re.match(r"create\s+table\s+([\w.]+)\s*\((.*)\)\s*$", s, re.I | re.S):
                _create(session, m[1], m[2])
            elif low.startswith("create"):
                raise UnsupportedFeature("CREATE VIEW or INDEX")
            elif low.startswith("insert"):
                _insert(session, planner, s)
            elif low.startswith("update"):
                _update(session, planner, s)
            elif low.startswith("delete"):
                _delete(session, planner, s)
            elif m := re.match(r"drop\s+table\s+(.*)$", s, re.I):
                for name in m[1].split(","):
                    session.work.pop(name.strip().lower().removeprefix("work."), None)
            elif low.startswith("alter"):
                _alter(session, s)
            elif low.startswith(("describe", "validate")):
                continue
            elif low in ("quit", "run"):
                continue
            else:
                raise ProgramError(f"SQL statement not known: {s[:40]}")
            session.macro.vars["sqlrc"] = "0"
        finally:
            session.options["inobs"] = None


#: Rows that a macro list or range may take; more end the program.
INTO_ROWS = 65_536


def _select(session, planner, s, noprint, opts):
    p = SqlParser(tokenize(s))
    q = p.query()
    df = planner.run(q)
    if opts.get("outobs"):
        df = df.limit(opts["outobs"])
    into = q.into if isinstance(q, Query) else []
    if into:
        from statloom.formats import best

        # Lists and open ranges take every row, the others only the first ones.
        rows = df.limit(INTO_ROWS + 1).collect()
        if len(rows) > INTO_ROWS:
            n = df.count()
            for item in into:
                last = re.match(r".*?(\d+)$", item["range"]) if item.get("range") else None
                if ("sep" in item or "range" in item) and not (last and int(last[1]) - int(re.match(r".*?(\d+)$", item["name"])[1]) < INTO_ROWS):
                    raise UnsupportedFeature(f"INTO of {n} rows, more than {INTO_ROWS}")
        else:
            n = len(rows)
        show = lambda v, trim: (best(v, 8) if not isinstance(v, str) else v).strip() if trim or not isinstance(v, str) else v
        for k, item in enumerate(into):
            col = [r[k] for r in rows]
            if "sep" in item:
                session.macro.vars[item["name"].lower()] = item["sep"].join(show(v, True).rstrip() for v in col)
            elif "range" in item:
                stem = re.match(r"(.*?)(\d+)$", item["name"])
                last = re.match(r".*?(\d+)$", item["range"]) if item["range"] else None
                for j, v in enumerate(col):
                    if last and j + int(stem[2]) > int(last[1]):
                        break
                    session.macro.vars[f"{stem[1]}{int(stem[2]) + j}".lower()] = show(v, True)
            elif col:
                v = col[0]
                session.macro.vars[item["name"].lower()] = show(v, item.get("trim")) if isinstance(v, str) else (best(v, 8) if not item.get("trim") else best(v, 8).strip())
        session.macro.vars["sqlobs"] = str(n)
    elif not noprint:
        from statloom.procs import listing

        n = listing(session, df)
        session.macro.vars["sqlobs"] = str(n)


def _create(session, name, body):
    fields, rules = [], []
    from statloom.plans.step import _commas

    for part in _commas(body):
        w = part.split()
        if w[0].lower() in ("constraint", "primary", "check", "unique", "foreign", "not"):
            rules.append(part.strip())
            continue
        kind = w[1].lower() if len(w) > 1 else "num"
        char = kind.startswith(("char", "varchar", "character"))
        meta = {}
        if m := re.search(r"\((\d+)\)", part):
            meta["len"] = int(m[1])
        for k, v in re.findall(r"\b(label|format|informat)\s*=\s*('[^']*'|\"[^\"]*\"|\S+)", part, re.I):
            meta[k.lower()] = v.strip("'\"")
        fields.append(T.StructField(w[0], T.StringType() if char else T.DoubleType(), True, meta))
        rest = part.lower()
        for rule in ("not null", "unique", "primary key"):
            if rule in rest:
                rules.append(f"{rule}({w[0]})" if rule != "not null" else f"not null({w[0]})")
        if m := re.search(r"check\s*\((.*)\)", part, re.I | re.S):
            rules.append(f"check({m[1]})")
    session.store(name, session.spark.createDataFrame([], T.StructType(fields)))
    session.constraints = getattr(session, "constraints", {})
    session.constraints[name.lower()] = rules


def _verify(session, name, df):
    """Constraints of the table, checked before a change is kept."""
    for rule in getattr(session, "constraints", {}).get(name.lower(), []):
        m = re.search(r"(not null|unique|primary key|check|foreign key)\s*\((.*?)\)\s*(references\s+(\w+))?$", rule, re.I | re.S)
        if not m:
            continue
        kind, body = m[1].lower(), m[2]
        cols = [c.strip() for c in body.split(",")]
        if kind in ("not null", "primary key"):
            for c in cols:
                char = isinstance(df.schema[c].dataType, T.StringType)
                if not df.where(F.rtrim(F.coalesce(F.col(c), F.lit(""))) == "" if char else F.col(c).isNull()).isEmpty():
                    raise ProgramError(f"{name}: {c} must not be missing")
        if kind in ("unique", "primary key") and not df.groupBy(*cols).count().where("count > 1").isEmpty():
            raise ProgramError(f"{name}: {body} must be unique")
        if kind == "check":
            from statloom.session import env_of

            ok = X.as_bool(X.to_column(SqlParser(tokenize(body)).parse(), env_of(df, session)), where=True)
            if not df.where(~ok).isEmpty():
                raise ProgramError(f"{name}: check {body} fails")
        if kind == "foreign key":
            other = session.table(m[4])
            key = [c for c in other.columns if c.lower() == cols[0].lower()][0]
            if not df.where(F.col(cols[0]).isNotNull()).join(other, df[cols[0]] == other[key], "left_anti").isEmpty():
                raise ProgramError(f"{name}: {body} has no partner in {m[4]}")


def _insert(session, planner, s):
    m = re.match(r"insert\s+into\s+([\w.]+)\s*(\(([^)]*)\))?\s*(.*)$", s, re.I | re.S)
    name, rest = m[1], m[4]
    df = session.table(name)
    cols = [c for c in df.columns if c != RID]
    into = [c.strip() for c in m[3].split(",")] if m[3] else cols
    kinds = {f.name.lower(): f.dataType for f in df.schema}
    if re.match(r"select\b", rest, re.I):
        new = planner.run(SqlParser(tokenize(rest)).query())
        new = new.toDF(*into[: len(new.columns)])
    else:
        rows = []
        if re.match(r"values\b", rest, re.I):
            for g in re.findall(r"\(((?:[^()']|'[^']*')*)\)", rest):
                p = X.Parser(tokenize(g))
                row = {}
                for c in into:
                    row[c.lower()] = X.evaluate(p.parse(), lambda n: None)
                    p.accept(",")
                rows.append(row)
        else:
            for part in re.split(r"\bset\b", rest, flags=re.I)[1:]:
                p, row = X.Parser(tokenize(part)), {}
                while p.peek():
                    c = p.take().text.lower()
                    p.expect("=")
                    row[c] = X.evaluate(p.parse(5), lambda n: None)
                    p.accept(",")
                rows.append(row)
        schema = T.StructType([T.StructField(c, kinds[c.lower()]) for c in cols])
        data = [tuple((r.get(c.lower()) if r.get(c.lower()) is not None else "") if isinstance(kinds[c.lower()], T.StringType) else r.get(c.lower()) for c in cols) for r in rows]
        new = session.spark.createDataFrame(data, schema)
    low = {c.lower(): c for c in new.columns}
    picked = [(F.col(low[c.lower()]) if c.lower() in low else F.lit("" if isinstance(kinds[c.lower()], T.StringType) else None)).cast(kinds[c.lower()]).alias(c) for c in cols]
    from statloom.operators.combine import concatenate

    both = concatenate(df, new.select(*picked)).withColumn(RID, F.col("__src").cast("long") * F.lit(1 << 53) + F.col(RID)).drop("__src")
    _verify(session, name, both)
    session.store(name, both)
    session.macro.vars["sqlobs"] = str(new.count())


def _scoped(session, planner, name, alias):
    scope = Scope()
    df = session.table(name)
    tagged = planner.tag(df, alias or name.split(".")[-1], scope)
    return df, tagged, scope


def _update(session, planner, s):
    m = re.match(r"update\s+([\w.]+)(?:\s+(?:as\s+)?(?!set\b)(\w+))?\s+set\s+(.*)$", s, re.I | re.S)
    p = SqlParser(tokenize(m[3]))
    sets, where = {}, None
    while True:
        c = p.take().text
        p.expect("=")
        sets[c.lower()] = p.parse()
        if not p.accept(","):
            break
    if p.accept("where"):
        where = p.parse()
    df, tagged, scope = _scoped(session, planner, m[1], m[2])
    env = planner.env(scope)
    if where is not None:
        tagged, where = planner.attach(tagged, where, scope)
    for k in list(sets):
        tagged, sets[k] = planner.attach(tagged, sets[k], scope)
    hit = X.as_bool(X.to_column(where, env), where=True) if where is not None else F.lit(True)
    tagged = tagged.withColumn("__hit", hit)
    out = []
    for _, name, inner in scope.order:
        c, kind = F.col(inner), scope.kinds[inner]
        if name.lower() in sets:
            new = X.to_column(sets[name.lower()], env)
            new = X.as_char(new) if kind == "c" else X.as_num(new)
            tagged = tagged.withColumn(f"__new_{inner}", new)
            c = F.when(F.col("__hit"), F.col(f"__new_{inner}")).otherwise(c)
        out.append(c.alias(name, metadata=scope.meta[inner]))
    rid = [F.col(r).alias(RID) for r in getattr(scope, "rids", [])[:1]]
    made = tagged.select(*out, *rid)
    _verify(session, m[1], made)
    session.store(m[1], made)


def _delete(session, planner, s):
    m = re.match(r"delete\s+(?:\*\s+)?from\s+([\w.]+)(?:\s+(?:as\s+)?(?!where\b)(\w+))?(?:\s+where\s+(.*))?$", s, re.I | re.S)
    df, tagged, scope = _scoped(session, planner, m[1], m[2])
    if m[3] is None:
        session.store(m[1], df.limit(0))
        return
    env = planner.env(scope)
    tagged, cond = planner.attach(tagged, SqlParser(tokenize(m[3])).parse(), scope)
    kept = tagged.where(~X.as_bool(X.to_column(cond, env), where=True))
    rid = [F.col(r).alias(RID) for r in getattr(scope, "rids", [])[:1]]
    session.store(m[1], kept.select(*[F.col(i).alias(n, metadata=scope.meta[i]) for _, n, i in scope.order], *rid))


def _alter(session, s):
    m = re.match(r"alter\s+table\s+([\w.]+)\s+(.*)$", s, re.I | re.S)
    df = session.table(m[1])
    for part in re.split(r"\b(?=(?:add|drop|modify)\b)", m[2], flags=re.I):
        w = part.strip().rstrip(",").split(None, 1)
        if not w:
            continue
        if w[0].lower() == "drop":
            gone = {c.strip().lower() for c in w[1].split(",")}
            df = df.drop(*[c for c in df.columns if c.lower() in gone])
        elif w[0].lower() == "add":
            if re.match(r"(constraint|primary|check|unique|foreign)\b", w[1], re.I):
                session.constraints = getattr(session, "constraints", {})
                session.constraints.setdefault(m[1].lower(), []).append(re.sub(r"^constraint\s+\w+\s+", "", w[1].strip(), flags=re.I))
                continue
            for d in w[1].split(","):
                f = d.split()
                char = len(f) > 1 and f[1].lower().startswith(("char", "varchar"))
                df = df.withColumn(f[0], F.lit("") if char else F.lit(None).cast("double"))
        else:
            for c, k, v in re.findall(r"(\w+)\s+(?:\w+\s+)?(label|format|informat)\s*=\s*('[^']*'|\S+)", w[1], re.I):
                name = next(x for x in df.columns if x.lower() == c.lower())
                meta = dict(df.schema[name].metadata or {}) | {k.lower(): v.strip("'\"")}
                df = df.withMetadata(name, meta)
    session.store(m[1], df)


