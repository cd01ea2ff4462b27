"""Quality rules as a short-circuit cascade, in built-in functions only.

Each rule rejects texts by one figure of theirs. On a sample of bounded size each rule's cost (the time
to find its figure) and selectivity (the share it rejects) are estimated; the rules then run in order of
rejection per cost, each only on texts that no rule before it rejected. The order changes how fast the
verdict is found and never the verdict.

All figures come from one row at a time: no shuffle, no join, one scan of doc_id and text. Repeated
windows of a text are found by sorting their hashes with their places, in time n log n.
"""

from __future__ import annotations

import time
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinspan.llm.words import word_array
from twinspan.sources.tables import table

WINDOW = 3
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DIGITS = "0123456789"
#: Rows that costs and selectivities are estimated on, none longer than so many characters, and how often each is timed.
SAMPLE, SAMPLE_CHARS, TIMED = 500, 50_000, 20


class Rule(NamedTuple):
    name: str
    rejects: str  # SQL over the columns of `figures`


def _without(text: Column, signs: str) -> Column:
    return F.length(F.translate(text, signs, ""))


def _among(text: Column, signs: str) -> Column:
    return (F.length(text) - _without(text, signs)).cast("long")


#: Rules that follow the base rules; each leaves prose in any language well alone.
RULES = (
    Rule("word_length", "word_chars < 2 * n_words or word_chars > 15 * n_words"),
    Rule("symbols", "n_symbols * 10 > 3 * n_words"),
    Rule("dup_lines", "n_dup_lines * 10 > 3 * _lines"),
    Rule("capitals", f"(length(_text) - length(translate(_text, '{CAPITALS}', ''))) * 2 > word_chars"),
    Rule("digits", f"(length(_text) - length(translate(_text, '{DIGITS}', ''))) * 10 > 3 * word_chars"),
)

BASE_FAILED = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"


def figures(docs: DataFrame) -> DataFrame:
    """doc_id, _text, n_words, word_chars, n_symbols, _lines, n_dup_lines and n_repeat_words of each row.

    A step of its own for each array that is used more than once, so that it is built once.
    """
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text"))
    has_word = lambda x: F.length(F.translate(x, BLANKS, "")) > 0
    d = d.select("*", word_array(F.col("_text")).alias("_words"), F.filter(F.split("_text", "\n"), has_word).alias("_split"))
    n = F.size("_words")
    at = lambda i, k: F.get("_words", i + k)
    windows = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*(at(i, k) for k in range(WINDOW))))
    lines = F.size("_split").cast("long")
    d = d.select(
        "doc_id", "_text", n.cast("long").alias("n_words"), _without(F.col("_text"), BLANKS).cast("long").alias("word_chars"), _among(F.col("_text"), SYMBOLS).alias("n_symbols"),
        lines.alias("_lines"), (lines - F.size(F.array_distinct("_split"))).cast("long").alias("n_dup_lines"), F.when(n >= WINDOW, windows).alias("_hashes"),
    )
    # Windows with their places in the low bits, sorted, so that equal ones are neighbours. Only where some are equal.
    some = F.size(F.array_distinct("_hashes")) < F.size("_hashes")
    d = d.select("*", F.when(some, F.ceil(F.log2(F.size("_hashes") + F.lit(1))).cast("int")).alias("_bits"))
    mask = F.expr("shiftleft(1L, _bits) - 1")
    d = d.select("*", mask.alias("_mask"))
    packed = F.transform("_hashes", lambda h, i: h.bitwiseAND(F.bitwise_not("_mask")).bitwiseOR(i.cast("long")))
    d = d.select("*", F.when(F.col("_bits").isNotNull(), F.sort_array(packed)).alias("_sorted"))
    window = lambda x: F.get("_hashes", x.bitwiseAND(F.col("_mask")).cast("int"))
    beside = lambda x, i: F.coalesce(window(x) == window(F.get("_sorted", i)), F.lit(False))
    starts = F.transform(F.filter("_sorted", lambda x, i: beside(x, i - 1) | beside(x, i + 1)), lambda x: x.bitwiseAND(F.col("_mask")))
    covered = F.size(F.array_distinct(F.flatten(F.transform(starts, lambda p: F.array(*(p + k for k in range(WINDOW)))))))
    return d.withColumn("n_repeat_words", F.when(F.col("_sorted").isNull(), 0).otherwise(covered).cast("long")).drop("_hashes", "_bits", "_mask", "_sorted")


def ordered(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample: int = SAMPLE) -> list[Rule]:
    """The rules, those first that reject most per second on a sample of the rows."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text").where(F.coalesce(F.length("text"), F.lit(0)) <= SAMPLE_CHARS).take(sample)  # of the first partitions that have as many
    if not rows:
        return list(rules)
    # The figures that all rules share are at hand, as in the cascade; what a rule adds to them is timed.
    known = spark.createDataFrame(figures(spark.createDataFrame(rows, docs.select("doc_id", "text").schema)).toArrow())
    known = known.withColumn("_again", F.explode(F.sequence(F.lit(1), F.lit(TIMED))))

    def measured(rejects: str) -> tuple[float, float]:
        seconds = []
        for _ in range(2):  # the first run compiles
            began = time.perf_counter()
            share = known.agg(F.avg(F.expr(rejects).cast("int"))).first()[0]
            seconds.append(time.perf_counter() - began)
        return min(seconds), share or 0.0

    floor, _ = measured("false")
    found = {r.name: measured(r.rejects) for r in rules}
    return sorted(rules, key=lambda r: (-found[r.name][1] / max(found[r.name][0] - floor, 1e-3), r.name))


def cascade(rules: list[Rule]) -> Column:
    """The first rule that rejects a row, or null; a rule is evaluated only if none before it rejects."""
    whens = "".join(f" when {r.rejects} then '{r.name}'" for r in rules)
    return F.expr(f"case{whens} end") if rules else F.lit(None).cast("string")


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) of every row.

    Null and empty texts have no words, so they fail the base. Repeated rows are judged each for itself and
    alike. An empty table gives no rows. Columns beside doc_id and text are left alone.
    """
    judged = figures(docs).withColumn("base_failed", F.expr(BASE_FAILED))
    kept = F.when(F.col("base_failed"), False).otherwise(cascade(ordered(docs, rules)).isNull())
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(table(spark, sf_dir, "documents"))


SQL = r"""
with d as (
  select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents
), w as (
  select rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from d
), g as (
  select rid, unnest(range(1, len(ws) - 1)) as p, unnest(list_transform(range(1, len(ws) - 1), lambda i: [ws[i], ws[i + 1], ws[i + 2]])) as win from w where len(ws) >= 3
), dup as (
  select rid, p from (select rid, p, count(*) over (partition by rid, win) as n from g) where n > 1
), rep as (
  select rid, count(distinct p + k) as n from dup, (select unnest([0, 1, 2]) as k) group by rid
), f as (
  select w.rid, doc_id, t, cast(len(ws) as bigint) as n_words, cast(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) as bigint) as word_chars,
    cast(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols, cast(len(ls) as bigint) as lines,
    cast(len(ls) - len(list_distinct(ls)) as bigint) as n_dup_lines, cast(coalesce(rep.n, 0) as bigint) as n_repeat_words,
    length(regexp_replace(t, '[^A-Z]', '', 'g')) as capitals, length(regexp_replace(t, '[^0-9]', '', 'g')) as digits
  from w left join rep on w.rid = rep.rid
), b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from f)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not (base_failed or word_chars < 2 * n_words or word_chars > 15 * n_words or n_symbols * 10 > 3 * n_words or n_dup_lines * 10 > 3 * lines
    or capitals * 2 > word_chars or digits * 10 > 3 * word_chars) as kept
from b
"""
