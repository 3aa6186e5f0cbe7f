"""Line dedup: ranged hashes, first occurrences in a stream, keep bitmaps instead of text.

DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statloom.llm.common import ASCII_SPACE, Scratch, ascii_lower, fresh_name, table


def split_lines(text: Column) -> Column:
    """The text's lines, split at \\n; null and empty texts have one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(ASCII_SPACE)))


def line_marks(docs: DataFrame, doc_id: str, text: str, min_chars: int) -> DataFrame:
    """(doc, pos, h1, h2, salt): a 128-bit hash for each line whose key has at least
    ``min_chars`` code points. The salt, of the document, deals a frequent line over
    as many as 64 ranges."""
    at = docs.select(F.col(doc_id).alias("doc"), F.posexplode(split_lines(F.col(text))).alias("pos", "line"))
    keyed = at.select("doc", "pos", F.btrim("line", F.lit(ASCII_SPACE)).alias("k")).where(F.length("k") >= min_chars)
    keyed = keyed.select("doc", "pos", ascii_lower("k").alias("k"))
    return keyed.select("doc", "pos", F.xxhash64("k").alias("h1"), F.xxhash64(F.lit(1), "k").alias("h2"), F.pmod(F.xxhash64("doc"), F.lit(64)).cast("int").alias("salt"))


def ranged(marks: DataFrame) -> DataFrame:
    """The marks range-partitioned by hash, each range sorted by hash, document and
    position, and streamed once: first is true where a (hash, salt) run begins,
    new_doc where its document does."""
    runs = marks.repartitionByRange("h1", "h2", "salt")
    w = Window.partitionBy("h1", "h2", "salt").orderBy("doc", "pos")
    before = F.lag(F.struct("doc")).over(w)
    return runs.select("*", before.isNull().alias("first"), (before.isNull() | ~before["doc"].eqNullSafe(F.col("doc"))).alias("new_doc"))


def drop_bitmaps(dropped: DataFrame) -> DataFrame:
    """(doc, words): for each document that loses lines, its bitmap of dropped lines as
    64-bit words by number. Words without a bit are left out, which keeps it small."""
    bits = dropped.groupBy("doc", F.shiftright("pos", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, pos & 63)")).alias("b"))
    return bits.groupBy("doc").agg(F.map_from_entries(F.collect_list(F.struct("w", "b"))).alias("words"))


def keep_bitmaps(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", mode: str = "frequent", min_docs: int = 10, min_chars: int = 1, scratch: Scratch | None = None) -> DataFrame:
    """(doc, words) for the documents that lose lines; see ``drop_bitmaps``.

    mode "frequent": keys found in at least ``min_docs`` documents lose every line.
    mode "first": of equal keys, the first by (doc, pos) stays, the others go.
    Keys shorter than ``min_chars`` code points never lose lines. Rows that share a
    doc_id are taken as one document of which each row has the lines that its own
    positions say: a position is dropped in all of them if in one. A null doc_id is an
    id like others. No documents, no rows."""
    scratch = scratch or Scratch(docs.sparkSession, "lines")
    marked = scratch.put(ranged(line_marks(docs, doc_id, text, min_chars)))
    per_key = marked.where("new_doc").groupBy("h1", "h2").agg(F.count("*").alias("n_docs"))
    if mode == "frequent":
        # Written, so that the join deals both sides itself and Spark can split a key's rows.
        frequent = scratch.put(per_key.where(F.col("n_docs") >= min_docs).select("h1", "h2"))
        gone = marked.select("h1", "h2", "doc", "pos").join(frequent, ["h1", "h2"])
    elif mode == "first":
        # What isn't first in its run goes anyway; of the firsts, all but the least.
        lead = marked.where("first").groupBy("h1", "h2").agg(F.min(F.struct("doc", "pos")).alias("lead"), F.count("*").alias("n")).where("n > 1")
        firsts = marked.where("first").join(lead, ["h1", "h2"]).where(F.struct("doc", "pos") != F.col("lead"))
        gone = marked.where("not first").select("h1", "h2", "doc", "pos").unionByName(firsts.select("h1", "h2", "doc", "pos"))
    else:
        raise ValueError(f"mode: frequent or first, not {mode}")
    return drop_bitmaps(gone)


def kept_lines(text: Column, words: Column) -> Column:
    """The lines of ``text`` whose bit isn't set in ``words`` (null: none is set)."""
    word = lambda i: F.coalesce(F.try_element_at(words, F.shiftright(i, 6)), F.lit(0).cast("long"))
    return F.filter(split_lines(text), lambda line, i: F.getbit(word(i), i.bitwiseAND(F.lit(63))) == 0)


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_lines: str = "n_lines", n_dropped: str = "n_dropped", **options) -> DataFrame:
    """``docs`` with ``text`` reduced to its kept lines, joined by \\n, and the counts
    ``n_lines`` (before) and ``n_dropped``. Options as for ``keep_bitmaps``.

    A document without lines left has the empty text; null texts become empty. Other
    columns pass through, whatever their names."""
    bitmaps = keep_bitmaps(docs, doc_id, text, **options)
    key, words = fresh_name(docs.columns, "bitmap_doc"), fresh_name(docs.columns, "bitmap_words")
    with_bits = docs.join(bitmaps.select(F.col("doc").alias(key), F.col("words").alias(words)), F.col(doc_id).eqNullSafe(F.col(key)), "left").drop(key)
    kept = fresh_name([*docs.columns, words], "kept")
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.length(whole) - F.length(F.replace(whole, F.lit("\n"), F.lit(""))) + 1
    dropped = F.when(F.col(words).isNull(), F.lit(0)).otherwise(F.size(split_lines(F.col(text))) - F.size(kept))
    held = with_bits.withColumn(kept, F.when(F.col(words).isNotNull(), kept_lines(F.col(text), F.col(words))))
    return held.select(
        *[c for c in docs.columns if c not in (text, n_lines, n_dropped)],
        F.when(F.col(words).isNull(), whole).otherwise(F.array_join(kept, "\n")).alias(text),
        lines.cast("long").alias(n_lines),
        dropped.cast("long").alias(n_dropped),
    )


def op1_query(spark, sf_dir):
    """Counts and a digest of the lines that stay of every document; see ``dedup_lines``."""
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), mode="frequent", min_docs=10, min_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


OP1_SQL = r"""
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos
  from documents),
keyed as (
  select doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
  from lines),
frequent as (
  select k from keyed where length(k) >= 1 group by k having count(distinct doc_id) >= 10)
select doc_id, count(*)::bigint as n_lines,
       sum(case when f.k is not null then 1 else 0 end)::bigint as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where f.k is null), '')) as kept_sha256
from keyed left join frequent f using (k) group by doc_id
"""
