"""Quality rules with adaptive thresholds from mergeable quantile sketches."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statloom.llm.common import Scratch, fresh_name, table

#: A fixed set: the characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Relative width of a sketch's buckets: quantiles are right within two per cent.
GAMMA = 1.02
SCALE = 1.0 / math.log(GAMMA)
#: Limits of at most so many languages and sources, some 300 bytes each, are broadcast.
BROADCAST_GROUPS = 50_000


def repeated_words(words: list[bytes], window: int = 8) -> int:
    """How many words lie in windows of ``window`` words that occur twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.uint64)
    if len(number) == len(words):
        return 0
    mixed = np.zeros(n, dtype=np.uint64)
    spread = ids * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)
    spread ^= spread >> np.uint64(29)
    for k in range(window):
        mixed = mixed * np.uint64(0xD6E8FEB86659FD93) + spread[k : k + n]
    order = np.argsort(mixed, kind="stable")
    ranked = mixed[order]
    equal = np.flatnonzero(ranked[1:] == ranked[:-1])
    if not len(equal):
        return 0
    hit = np.unique(np.concatenate((order[equal], order[equal + 1])))
    windows = np.lib.stride_tricks.sliding_window_view(ids, window)[hit]
    # Hashes only chose the candidates: equality is of the words.
    _, inverse, counts = np.unique(windows, axis=0, return_inverse=True, return_counts=True)
    hit = hit[counts[inverse.ravel()] > 1]
    cover = np.zeros(len(words) + 1, dtype=np.int64)
    cover[hit] += 1
    cover[hit + window] -= 1
    return int(np.count_nonzero(np.cumsum(cover[:-1])))


def _code_points(b: bytes) -> int:
    return len(b) if b.isascii() else len(b.decode("utf-8", "replace"))


def count_text(text: bytes | None) -> tuple[int, int, int, int, int]:
    """The five counts of ``COUNTS``; all 0 for null."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.split()
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    seen: set[bytes] = set()
    dup = 0
    if b"\n" in text:
        for line in text.split(b"\n"):
            if line in seen:
                dup += bool(line.split(None, 1))
            else:
                seen.add(line)
    return len(words), _code_points(b"".join(words)), symbols, dup, repeated_words(words)


def with_counts(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds the counts of ``COUNTS``; columns of those names are replaced."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in COUNTS]
    # A text that stays is sent to the workers once.
    raw = text if text in keep else fresh_name(keep, "raw")
    given = docs.select(*keep) if text in keep else docs.select(*keep, F.col(text).alias(raw))
    schema = docs.select(*keep, *[F.lit(0).cast("long").alias(c) for c in COUNTS]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.schema.get_field_index(raw)).cast(pa.binary())
            rows = np.array([count_text(x.as_py()) for x in texts], dtype=np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *map(pa.array, rows.T.copy())], names=[*keep, *COUNTS])

    return given.mapInArrow(run, schema)


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


#: Metrics whose high values tell bad documents, as parts of a document's words.
METRICS = {
    "symbols": "n_symbols / n_words",
    "dup_lines": "n_dup_lines / n_words",
    "repeats": "n_repeat_words / n_words",
    "long_words": "word_chars / n_words",
    "short_words": "n_words / word_chars",
}
#: Smallest excess over the third quartile, in the metric's units, that can reject: in
#: groups of one kind of text the quartiles nearly meet, and the range says nothing.
SLACK = {"symbols": 0.1, "dup_lines": 0.1, "repeats": 0.3, "long_words": 4.0, "short_words": 0.2}


def _bucket(x: Column) -> Column:
    """A sketch's bucket: 0 for 0, else the logarithm's floor, so that buckets of any two
    sketches add up."""
    return F.when(x <= 0, F.lit(None)).otherwise(F.floor(F.ln(x) * SCALE)).cast("int")


def sketch(counts: DataFrame, groups: list[str]) -> DataFrame:
    """(groups..., metric, bucket, n): quantile sketches as bucket counts. Sketches of
    parts merge by adding n, and a group's size bounds neither a row nor a task: partial
    sums leave each task as at most some hundred buckets a group and metric."""
    each = F.array(*[F.struct(F.lit(m).alias("metric"), _bucket(F.expr(e)).alias("bucket")) for m, e in METRICS.items()])
    rows = counts.where("n_words > 0").select(*groups, F.explode(each).alias("m"))
    return rows.groupBy(*groups, F.col("m.metric").alias("metric"), F.col("m.bucket").alias("bucket")).agg(F.count("*").alias("n"))


def quantiles(sketches: DataFrame, groups: list[str], probabilities: dict[str, float]) -> DataFrame:
    """(groups..., metric, total, one column per probability), read off the sketches: the
    middle of the bucket that holds the rank."""
    w = Window.partitionBy(*groups, "metric").orderBy(F.col("bucket").asc_nulls_first())
    whole = Window.partitionBy(*groups, "metric")
    run = sketches.withColumn("to", F.sum("n").over(w)).withColumn("total", F.sum("n").over(whole))
    value = F.when(F.col("bucket").isNull(), F.lit(0.0)).otherwise(F.exp((F.col("bucket") + 0.5) / SCALE))
    picks = [F.min(F.when(F.col("to") >= F.ceil(F.col("total") * p), value)).alias(name) for name, p in probabilities.items()]
    return run.groupBy(*groups, "metric").agg(F.max("total").alias("total"), *picks)


def thresholds(counts: DataFrame, lang: str = "lang", source: str = "source", fence: float = 6.0, least: int = 200) -> DataFrame:
    """(lang, source, limits): for each language and source, the most that each metric
    may be: the third quartile plus the larger of ``fence`` interquartile ranges and the
    metric's slack. Groups of under ``least`` documents take their language's limits,
    whose sketch merges its sources', and those of small languages the whole corpus's.
    ``limits`` is a map by metric."""
    fine = sketch(counts, [lang, source])
    by_lang = fine.groupBy(lang, "metric", "bucket").agg(F.sum("n").alias("n"))
    all_ = by_lang.groupBy("metric", "bucket").agg(F.sum("n").alias("n"))
    q = {"q1": 0.25, "q3": 0.75}

    def limits(sketches: DataFrame, groups: list[str], name: str) -> DataFrame:
        slack = F.coalesce(*[F.when(F.col("metric") == m, F.lit(s)) for m, s in SLACK.items()])
        most = F.col("q3") + F.greatest(fence * (F.col("q3") - F.col("q1")), slack)
        per = quantiles(sketches, groups, q).where(F.col("total") >= least) if groups else quantiles(sketches, groups, q)
        return per.groupBy(*groups).agg(F.map_from_entries(F.collect_list(F.struct("metric", most.alias("most")))).alias(name))

    groups = fine.select(lang, source).distinct()
    a = limits(fine, [lang, source], "own")
    b = limits(by_lang, [lang], "of_lang")
    c = limits(all_, [], "of_all")
    g = groups.alias("g")
    a2 = a.select(F.col(lang).alias("_l"), F.col(source).alias("_s"), "own")
    b2 = b.select(F.col(lang).alias("_m"), "of_lang")
    joined = g.join(a2, F.col(f"g.{lang}").eqNullSafe(F.col("_l")) & F.col(f"g.{source}").eqNullSafe(F.col("_s")), "left")
    joined = joined.join(b2, F.col(f"g.{lang}").eqNullSafe(F.col("_m")), "left").join(F.broadcast(c), F.lit(True), "left")
    return joined.select(F.col(f"g.{lang}").alias(lang), F.col(f"g.{source}").alias(source), F.coalesce("own", "of_lang", "of_all").alias("limits"))


def verdict(limits: Column) -> Column:
    """Whether every metric stays within its limit; without limits, yes."""
    within = F.lit(True)
    for m, e in METRICS.items():
        within = within & F.coalesce(F.expr(e) <= F.try_element_at(limits, F.lit(m)), F.lit(True))
    return within


def judge(counts: DataFrame, lang: str = "lang", source: str = "source", basis: DataFrame | None = None, **options) -> DataFrame:
    """Adds base_failed and kept to rows that have the counts. Thresholds come from
    ``basis`` (the same rows by default) of documents that the base rules pass, so junk
    doesn't widen them. Null languages and sources are groups of their own."""
    limits = thresholds((counts if basis is None else basis).where(~base_failed()), lang, source, **options)
    at = fresh_name(counts.columns, "limits")
    l2, s2 = fresh_name(counts.columns, "limit_lang"), fresh_name(counts.columns, "limit_source")
    limits = limits.select(F.col(lang).alias(l2), F.col(source).alias(s2), F.col("limits").alias(at))
    # One small row a group: broadcast where that is checked, so that texts stay where they
    # are and a large source's rows need not meet; beyond it the join is Spark's to deal.
    limits = Scratch(counts.sparkSession, "limits").put(limits)
    if limits.count() <= BROADCAST_GROUPS:
        limits = F.broadcast(limits)
    out = counts.join(limits, F.col(lang).eqNullSafe(F.col(l2)) & F.col(source).eqNullSafe(F.col(s2)), "left")
    out = out.withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & verdict(F.col(at))).drop(at, l2, s2)


def quality_filter(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", **options) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their columns.

    Counts are written once, beside the rows, so no text is shuffled and rows need no key;
    they may repeat. Null and empty texts have no words and fail the base rules; a value
    equal to its limit stays. An empty table stays empty."""
    scratch = Scratch(docs.sparkSession, "quality")
    names = {c: fresh_name([*docs.columns, *COUNTS], f"as_{k}") for k, c in enumerate(docs.columns)}
    plain = docs.select(*[F.col(c).alias(n) for c, n in names.items()])
    judged = judge(scratch.put(with_counts(plain, names[text])), names[lang], names[source], **options)
    return judged.where("kept").select(*[F.col(n).alias(c) for c, n in names.items()])


def op7_query(spark, sf_dir):
    """Counts and verdicts of every document; see ``with_counts`` and ``judge``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    counts = Scratch(spark, "quality").put(with_counts(docs, "text", ["doc_id", "lang", "source"]))
    return judge(counts).select("doc_id", *COUNTS, "base_failed", "kept")


_SQL_METRICS = ", ".join(f"{{'m': '{m}', 'x': {e.replace('n_', 'q.n_').replace('word_chars', 'q.word_chars')}, 'slack': {SLACK[m]}}}" for m, e in METRICS.items())

OP7_SQL = rf"""
with d as (
  select doc_id, lang, source, coalesce(text, '') as text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
lines as (
  select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from d),
dup as (
  select doc_id, count(*) as n from (
    select *, row_number() over (partition by doc_id, line order by pos) as k from lines)
  where k > 1 and regexp_matches(line, '[^\x20\x09-\x0D]') group by 1),
win as (
  select doc_id, i, array_to_string(ws[i:i + 7], ' ') as w from (select doc_id, ws, unnest(range(1, len(ws) - 6)) as i from d)),
hit as (select doc_id, i from (select *, count(*) over (partition by doc_id, w) as n from win) where n > 1),
rep as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(i, i + 8)) as p from hit) group by 1),
q as (
  select d.doc_id, lang, source, len(ws)::bigint as n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::bigint as word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols, coalesce(dup.n, 0)::bigint as n_dup_lines, coalesce(rep.n, 0)::bigint as n_repeat_words
  from d left join dup using (doc_id) left join rep using (doc_id)),
q2 as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from q),
metric as (
  select doc_id, lang, source, base_failed, e.m as m, e.x as x, e.slack as slack, case when e.x > 0 then floor(ln(e.x) * {SCALE!r})::int end as bucket
  from (select doc_id, lang, source, base_failed, unnest([{_SQL_METRICS}]) as e from q2 q where n_words > 0)),
fine as (select lang, source, m, slack, bucket, count(*) as n from metric where not base_failed group by all),
lvl as (
  select 0 as lv, lang, source, m, slack, bucket, n from fine
  union all select 1, lang, null, m, slack, bucket, sum(n) from fine group by all
  union all select 2, null, null, m, slack, bucket, sum(n) from fine group by all),
run as (
  select *, sum(n) over (partition by lv, lang, source, m order by bucket nulls first) as upto, sum(n) over (partition by lv, lang, source, m) as total,
         case when bucket is null then 0.0 else exp((bucket + 0.5) / {SCALE!r}) end as v from lvl),
quart as (
  select lv, lang, source, m, slack, max(total) as total, min(case when upto >= ceil(total * 0.25) then v end) as q1, min(case when upto >= ceil(total * 0.75) then v end) as q3
  from run group by all),
lim as (select *, q3 + greatest(6.0 * (q3 - q1), slack) as most from quart where total >= 200 or lv = 2),
over as (
  select metric.doc_id, count(*) as n from metric
  left join lim a on a.lv = 0 and a.lang is not distinct from metric.lang and a.source is not distinct from metric.source and a.m = metric.m
  left join lim b on b.lv = 1 and b.lang is not distinct from metric.lang and b.m = metric.m
  left join lim c on c.lv = 2 and c.m = metric.m
  where metric.x > coalesce(a.most, b.most, c.most) group by 1)
select q2.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and over.n is null as kept
from q2 left join over using (doc_id)
"""
