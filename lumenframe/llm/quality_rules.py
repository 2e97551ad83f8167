"""Quality rules as a bitmask ledger: each rule is evaluated once, policies are applied later.

``ledger`` measures every document and gives one bit per failed rule; ``store`` writes it as Parquet
with the version of the rules, and ``open_ledger`` refuses one of other rules. A policy is a named,
versioned mask over those bits, so a verdict on a stored ledger is one bitwise AND, and rules can be
switched without reading a text again. ``ablation`` says, for each rule of a policy, how many
documents it rejects, how many only it rejects, and how many would be kept without it: the ledger is
folded to its distinct masks first.

Everything is built-in column expressions; no shuffle but for the ablation's counts.

Defined results: a null text has no words and fails ``few_words``; repeated rows are measured
one by one; an empty table gives an empty ledger; columns besides the id and the text are
ignored by ``ledger`` and carried along by ``judge``, boxed so that names cannot clash; the ablation
of an empty ledger has a row of zeros for each rule.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import boxed, shared_dir, table, text_or_empty, unboxed, words_of

SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_distinct_words")
#: Bit of each rule; bits are never reused, so that stored ledgers stay readable.
RULE_SET = "rules-1"
RULES = {"few_words": 0, "repeats": 1, "symbols": 2, "dup_lines": 3, "shouting": 4, "word_length": 5, "poor_vocabulary": 6}


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << RULES[r] for r in self.rules)


BASE = Policy("base-1", ("few_words", "repeats"))
LENIENT = Policy("lenient-1", ("few_words", "repeats", "symbols", "word_length"))
DEFAULT = Policy("default-1", ("few_words", "repeats", "symbols", "dup_lines", "shouting", "word_length", "poor_vocabulary"))


def _failed(rule: str) -> Column:
    """Whole-number arithmetic on the measures, so every engine gives the same verdict."""
    n, chars = F.col("_q_n_words"), F.col("_q_word_chars")
    return {
        "few_words": n < 10,
        "repeats": 100 * F.col("_q_n_repeat_words") > 20 * n,
        "symbols": 100 * F.col("_q_n_symbols") > 4 * chars,
        "dup_lines": (F.col("_q_n_dup_lines") >= 4) & (100 * F.col("_q_n_dup_lines") > 50 * F.col("_q_n_lines")),
        "shouting": (F.col("_q_n_letters") >= 20) & (100 * F.col("_q_n_upper") > 40 * F.col("_q_n_letters")),
        "word_length": (chars < 2 * n) | (chars > 20 * n),
        "poor_vocabulary": (n >= 20) & (100 * F.col("_q_n_distinct_words") < F.when(n < 200, 30).otherwise(5) * n),
    }[rule]


def measured(docs: DataFrame, text: str = "text", window: int = 5) -> DataFrame:
    """row (the columns of docs), the measures and fail_bits."""
    t = text_or_empty(F.col("row").getField(text))
    one = boxed(docs).select(
        "row",
        words_of(t).alias("_q_words"),
        F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_q_line_list"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("_q_n_symbols"),
        F.length(F.regexp_replace(t, r"\P{Lu}+", "")).cast("long").alias("_q_n_upper"),
        F.length(F.regexp_replace(t, r"\P{L}+", "")).cast("long").alias("_q_n_letters"),
    )
    w, lines = F.col("_q_words"), F.col("_q_line_list")
    starts = F.sequence(F.lit(1), F.size(w) - (window - 1))
    two = one.select(
        "row", "_q_words", "_q_n_symbols", "_q_n_upper", "_q_n_letters",
        F.size(w).cast("long").alias("_q_n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("_q_word_chars"),
        F.size(lines).cast("long").alias("_q_n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("_q_n_dup_lines"),
        F.size(F.array_distinct(w)).cast("long").alias("_q_n_distinct_words"),
        F.when(F.size(w) >= window, F.transform(starts, lambda i: F.xxhash64(F.slice(w, i, window)))).alias("_q_hashes"),
    )
    h = F.col("_q_hashes")
    # different hashes mean different windows; only texts in which a hash recurs sort the windows themselves
    three = two.withColumn(
        "_q_sorted",
        F.when(
            F.size(F.array_distinct(h)) < F.size(h),
            F.sort_array(F.transform(starts, lambda i: F.struct(F.array_join(F.slice(w, i, window), " ").alias("w"), i.alias("i")))),
        ),
    )
    s = F.col("_q_sorted")
    again = F.filter(s, lambda x, k: (F.get(s, k - 1)["w"] == x["w"]) | (F.get(s, k + 1)["w"] == x["w"]))
    covered = F.aggregate(
        F.sort_array(F.transform(again, lambda x: x["i"])),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, i: F.struct((a["n"] + i + window - F.greatest(a["end"], i)).alias("n"), (i + window).alias("end")),
        lambda a: a["n"],
    )
    out = three.withColumn("_q_n_repeat_words", F.coalesce(F.when(s.isNotNull(), covered), F.lit(0)).cast("long"))
    bits = F.lit(0).cast("long")
    for rule, bit in RULES.items():
        bits = bits.bitwiseOR(F.when(_failed(rule), F.lit(1 << bit)).otherwise(F.lit(0)).cast("long"))
    return out.select("row", *[F.col(f"_q_{m}").alias(m) for m in MEASURES], bits.alias("fail_bits"))


def ledger(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The ledger alone: id, measures, fail_bits; small enough to store and to judge again and again."""
    return measured(docs.select(id_col, text), text).select(F.col("row").getField(id_col).alias(id_col), *MEASURES, "fail_bits")


def store(led: DataFrame, path: str | None = None) -> str:
    """Write a ledger (or measured rows) with its rule set's version; the folder's path."""
    path = path or shared_dir(led.sparkSession)
    led.withColumn("rule_set", F.lit(RULE_SET)).write.option("compression", "zstd").parquet(path)
    return path


def open_ledger(spark, path: str) -> DataFrame:
    """A stored ledger; raises if other rules wrote it."""
    led = spark.read.parquet(path)
    if not led.where(F.col("rule_set") != RULE_SET).isEmpty():
        raise ValueError(f"the ledger was not written by {RULE_SET}")
    return led.drop("rule_set")


def verdict(fail_bits: Column, policy: Policy) -> Column:
    """True where no rule of the policy failed."""
    return fail_bits.bitwiseAND(F.lit(policy.mask)) == 0


def ablation(led: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """One row per rule: rejected by it, by it alone, kept in all, kept if it were dropped.

    The documents are counted by their masked bits first (at most two to the number of rules rows),
    then every mask is taken apart into the policy's rules.
    """
    seen = led.groupBy(F.col("fail_bits").bitwiseAND(F.lit(policy.mask)).alias("bits")).agg(F.count("*").alias("n"))
    # a row of no documents, so that every rule has a row
    seen = seen.unionByName(led.sparkSession.createDataFrame([(0, 0)], "bits long, n long"))
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << RULES[r]).cast("long").alias("bit")) for r in policy.rules])
    each = seen.select("bits", "n", F.explode(rules).alias("r")).select("bits", "n", "r.rule", "r.bit")
    count = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    return each.groupBy("rule").agg(
        count(F.col("bits").bitwiseAND(F.col("bit")) != 0).alias("n_rejected"),
        count(F.col("bits") == F.col("bit")).alias("n_only"),
        count(F.col("bits") == 0).alias("n_kept"),
        count((F.col("bits") == 0) | (F.col("bits") == F.col("bit"))).alias("n_kept_without"),
    ).select(F.lit(policy.version).alias("version"), "rule", "n_rejected", "n_only", "n_kept", "n_kept_without")


def judge(docs: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """The documents that pass the policy, with their own columns only; the ledger is stored with them first."""
    led = open_ledger(docs.sparkSession, store(measured(docs).select("row", "fail_bits")))
    return unboxed(led.where(verdict(F.col("fail_bits"), policy)))


def stored_ledger(spark, sf_dir) -> DataFrame:
    """The ledger of documents, written and read back."""
    return open_ledger(spark, store(ledger(table(spark, sf_dir, "documents"))))


def query(spark, sf_dir) -> DataFrame:
    base = verdict(F.col("fail_bits"), BASE)
    return stored_ledger(spark, sf_dir).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~base).alias("base_failed"), (base & verdict(F.col("fail_bits"), DEFAULT)).alias("kept"), "fail_bits",
    )


def ablation_query(spark, sf_dir) -> DataFrame:
    """Ablations of two policy versions over one stored ledger."""
    led = stored_ledger(spark, sf_dir)
    return ablation(led, DEFAULT).unionByName(ablation(led, LENIENT))


SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
win AS (SELECT doc_id, i, array_to_string(words[i:i+4], ' ') AS g
        FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)),
rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n >= 2),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i, unnest(range(0, 5)) AS k FROM rep) GROUP BY 1),
m AS (SELECT w.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
             len(lines) AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
             coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
             length(regexp_replace(text, '\P{Lu}+', '', 'g')) AS n_upper, length(regexp_replace(text, '\P{L}+', '', 'g')) AS n_letters,
             len(list_distinct(words)) AS n_distinct
      FROM w LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, (n_words < 10)::BIGINT + 2 * (100 * n_repeat_words > 20 * n_words)::BIGINT + 4 * (100 * n_symbols > 4 * word_chars)::BIGINT
             + 8 * (n_dup_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines)::BIGINT + 16 * (n_letters >= 20 AND 100 * n_upper > 40 * n_letters)::BIGINT
             + 32 * (word_chars < 2 * n_words OR word_chars > 20 * n_words)::BIGINT + 64 * (n_words >= 20 AND 100 * n_distinct < CASE WHEN n_words < 200 THEN 30 ELSE 5 END * n_words)::BIGINT AS fail_bits FROM m)
"""
_MEASURED = SQL
SQL = _MEASURED + "SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits FROM b"
ABLATION_SQL = _MEASURED + """,
p AS (SELECT unnest([{'version': 'default-1', 'mask': 127}, {'version': 'lenient-1', 'mask': 39}]) AS p),
r AS (SELECT unnest([{'rule': 'few_words', 'bit': 1}, {'rule': 'repeats', 'bit': 2}, {'rule': 'symbols', 'bit': 4}, {'rule': 'dup_lines', 'bit': 8},
                     {'rule': 'shouting', 'bit': 16}, {'rule': 'word_length', 'bit': 32}, {'rule': 'poor_vocabulary', 'bit': 64}]) AS r)
SELECT p.version AS version, r.rule AS rule, count(*) FILTER (WHERE fail_bits & r.bit <> 0) AS n_rejected, count(*) FILTER (WHERE fail_bits & p.mask = r.bit) AS n_only,
       count(*) FILTER (WHERE fail_bits & p.mask = 0) AS n_kept, count(*) FILTER (WHERE fail_bits & p.mask & ~r.bit = 0) AS n_kept_without
FROM b, p, r WHERE r.bit & p.mask <> 0 GROUP BY ALL
"""
