"""Operator 12, filter interaction audit: what five filters remove alone, together and in every order.

Documents become cells first: how many share part, failure flags and labels. A CUBE over the five flags and
part then has, among its grouping sets, one for each subset of the filters; its row whose selected flags are
all false counts the subset's survivors. A step of an order goes from one subset to the next larger one, so
joining the two subsets' survivors gives what the step keeps and removes.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from offerlens.llm import common

FILTERS = "ABCDE"
_FLAGS = [f.lower() for f in FILTERS]
_ALL = (1 << len(FILTERS)) - 1
_LEAST = -(1 << 63)


def failures(text: Column) -> dict[str, Column]:
    """The conditions that hang on a text alone; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n, capitals = F.size(words), F.char_length(text) - F.char_length(F.regexp_replace(text, "[A-Z]", ""))
    return {
        "a": n < 200,
        "b": 100 * F.size(F.array_distinct(words)) < 50 * n,
        "c": 100 * capitals.cast("long") > 3 * F.char_length(text).cast("long"),
        "d": text.rlike(r"[#$%&*|]"),
    }


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """n of documents by part, the flags a to e, good and toxic.

    e compares texts by SHA-256. Copies are counted by (text, part, labels) before they meet, and what meets of
    one text then is a row for each part and kind of label, however many copies it has. A null doc_id counts as
    the least long; rows that repeat the least id of a text all pass e, as no id is smaller. A document is good
    or toxic if any row of labels for its id says 1; null ids have no labels.
    """
    key, flags = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)), failures(F.col("text"))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST)).alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), key.alias("key"), *(c.alias(k) for k, c in flags.items()))
    once = rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    seen = once.join(marks, "doc_id", "left").fillna(False, ["good", "toxic"])
    kinds = [*flags, "good", "toxic"]
    same = seen.groupBy("key", "part", *kinds).agg(F.sum("n").alias("n"), F.min("doc_id").alias("first"), F.min_by("n", "doc_id").alias("n_first"))
    least = F.min("first").over(Window.partitionBy("key"))
    passes = F.when(F.col("first") == least, F.col("n_first")).otherwise(0)
    split = same.withColumn("passes", passes).select("part", *kinds, F.explode(F.array(F.struct(F.lit(False).alias("e"), F.col("passes").alias("n")), F.struct(F.lit(True).alias("e"), (F.col("n") - F.col("passes")).alias("n")))).alias("s"))
    return split.where("s.n > 0").groupBy("part", *flags, "s.e", "good", "toxic").agg(F.sum("s.n").alias("n"))


def survivors(counted: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic) for every part and every subset of the filters, zeros included; bit i of mask is filter i."""
    cube = counted.cube("part", *_FLAGS).agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"),
        F.grouping("part").alias("whole"), sum((1 - F.grouping(f)).cast("int") * (1 << i) for i, f in enumerate(_FLAGS)).alias("mask"),
    )
    clean = [~F.coalesce(F.col(f), F.lit(False)) for f in _FLAGS]
    for c in clean[1:]:
        clean[0] = clean[0] & c
    found = cube.where((F.col("whole") == 0) & clean[0]).select("part", "mask", "n", "good", "toxic")
    grid = counted.select("part").distinct().select("part", F.explode(F.sequence(F.lit(0), F.lit(_ALL))).alias("mask"))
    return grid.join(found, ["part", "mask"], "left").fillna(0, ["n", "good", "toxic"])


def _steps(df: DataFrame) -> DataFrame:
    """(filter_order, step, bit, before, after): the orders of five filters are a fixed table of 600 steps."""
    rows = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for i, f in enumerate(order):
            rows.append(("".join(FILTERS[g] for g in order), i + 1, 1 << f, before, before | 1 << f))
            before |= 1 << f
    return df.sparkSession.createDataFrame(rows, "filter_order string, step int, bit int, before int, after int")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, filter_order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Takes doc_id, text and lang of docs and doc_id, quality and toxic of labels; other columns are left out.
    Null and empty texts are one text without words; a null or empty lang is the part ''. No documents, no rows.
    """
    counted = common.materialize(cells(docs, labels), "filter-cells")  # a row for each part, flags and labels; read twice below
    s = common.materialize(survivors(counted), "filter-survivors")  # 32 rows a part, met by six joins
    common.discard(counted)
    at = lambda mask, name, *more: s.select("part", F.col("mask").alias(mask), F.col("n").alias(name), *more)
    steps = _steps(docs).withColumn("alone", F.col("bit")).withColumn("others", F.lit(_ALL) - F.col("bit")).withColumn("none", F.lit(0)).withColumn("all", F.lit(_ALL))
    pairs = steps.join(at("before", "n_before", F.col("good").alias("good_before"), F.col("toxic").alias("toxic_before")), "before")
    pairs = pairs.join(at("after", "kept", "good", "toxic"), ["part", "after"]).withColumn("removed", F.col("n_before") - F.col("kept"))
    for mask, name in (("none", "n_all"), ("alone", "n_alone"), ("others", "n_others"), ("all", "n_left")):
        pairs = pairs.join(at(mask, name), ["part", mask])
    return pairs.select(
        "part", "filter_order", "step", "kept", "removed", (F.col("n_all") - F.col("n_alone") - F.col("removed")).alias("redundant"), (F.col("n_others") - F.col("n_left")).alias("unique_fails"),
        (F.col("good_before") - F.col("good")).alias("good_lost"), (F.col("toxic_before") - F.col("toxic")).alias("toxic_lost"), F.sum("removed").over(Window.partitionBy("part", "bit")).alias("shapley"),
    )


SQL = r"""
with flagged as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w
  from documents),
failing as (
  select doc_id, part,
    (case when len(w) < 200 then 'A' else '' end)
    || (case when 100 * len(list_distinct(w)) < 50 * len(w) then 'B' else '' end)
    || (case when 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t) then 'C' else '' end)
    || (case when regexp_matches(t, '[#$%&*|]') then 'D' else '' end)
    || (case when doc_id > min(doc_id) over (partition by t) then 'E' else '' end) as fails
  from flagged),
marked as (
  select part, fails, coalesce(good, 0) as good, coalesce(bad, 0) as bad from failing
  left join (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as bad from labels group by doc_id) using (doc_id)),
cell as (select part, fails, good, bad, count(*) as n from marked group by all),
letter as (select unnest(['A', 'B', 'C', 'D', 'E']) as l),
filter_orders as (
  select a.l || b.l || c.l || d.l || e.l as filter_order from letter a, letter b, letter c, letter d, letter e
  where a.l not in (b.l, c.l, d.l, e.l) and b.l not in (c.l, d.l, e.l) and c.l not in (d.l, e.l) and d.l <> e.l),
met as (
  select part, filter_order, fails, good, bad, n,
    least(case when contains(fails, 'A') then instr(filter_order, 'A') else 9 end, case when contains(fails, 'B') then instr(filter_order, 'B') else 9 end,
      case when contains(fails, 'C') then instr(filter_order, 'C') else 9 end, case when contains(fails, 'D') then instr(filter_order, 'D') else 9 end,
      case when contains(fails, 'E') then instr(filter_order, 'E') else 9 end) as out_at
  from cell, filter_orders),
stepped as (
  select part, filter_order, cast(step as int) as step, substr(filter_order, step, 1) as f,
    sum(case when out_at > step then n else 0 end)::bigint as kept,
    sum(case when out_at = step then n else 0 end)::bigint as removed,
    sum(case when out_at < step and contains(fails, substr(filter_order, step, 1)) then n else 0 end)::bigint as redundant,
    sum(case when fails = substr(filter_order, step, 1) then n else 0 end)::bigint as unique_fails,
    sum(case when out_at = step and good = 1 then n else 0 end)::bigint as good_lost,
    sum(case when out_at = step and bad = 1 then n else 0 end)::bigint as toxic_lost
  from met, (select unnest(range(1, 6)) as step) group by 1, 2, 3, 4)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) over (partition by part, f))::bigint as shapley
from stepped
"""
