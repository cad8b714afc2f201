"""Quality rules as a ledger of failure bits, with DataFrame functions only.

Every rule is evaluated once on the whole text. The ledger keeps each measurement and one bit a failed rule;
policies are versioned masks of bits, so verdicts and ablations of any policy come from the stored bits by
bitwise operations, without reading a text again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

#: White space that ends a word: [\x20\x09-\x0D].
SPACE = " \t\n\x0b\x0c\r"
_GAP = "[\\x20\\x09-\\x0D]+"
_SYMBOLS = "#*$%&|<>"

#: Rule to the condition of failure over the measurements. Bit k is the k-th rule's; only append.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "symbols": "5 * n_symbols > n_words",
    "shouting": "2 * n_upper > n_upper + n_lower",
    "exclamations": "4 * n_exclamations > n_words",
    "duplicate_lines": "2 * n_dup_lines > n_lines",
    "word_length": "word_chars > 25 * n_words",
}

#: Version to the rules that reject.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols", "shouting", "exclamations", "duplicate_lines", "word_length"),
}


def mask(policy: str) -> int:
    """The bits of a policy's rules."""
    names = list(RULES)
    return sum(1 << names.index(rule) for rule in POLICIES[policy])


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def _measured(docs: DataFrame, text: str, prefix: str) -> DataFrame:
    """``docs`` with the measurements, named with ``prefix``. Each step is a projection of its own: arrays are made once."""
    t, w, tri, rep = (f"{prefix}{x}" for x in ("text", "words", "windows", "repeated"))
    c = F.col
    out = docs.withColumn(t, F.coalesce(c(text).cast("string"), F.lit("")))
    trimmed = F.btrim(c(t), F.lit(SPACE))
    out = out.withColumn(w, F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, _GAP)))
    # Hash and place of each window of three words, sorted, so that equal windows are neighbours.
    n = F.size(w)
    window = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.xxhash64(F.get(c(w), i), F.get(c(w), i + 1), F.get(c(w), i + 2)).alias("h"), i.alias("p")))
    out = out.withColumn(tri, F.when(n >= 3, F.sort_array(window)))
    same = F.filter(c(tri), lambda x, j: x["h"].eqNullSafe(F.get(c(tri), j - 1)["h"]) | x["h"].eqNullSafe(F.get(c(tri), j + 1)["h"]))
    out = out.withColumn(rep, same)
    covered = F.array_distinct(F.flatten(F.transform(c(rep), lambda x: F.array(x["p"], x["p"] + 1, x["p"] + 2))))
    lines = F.filter(F.split(c(t), "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    out = out.withColumn(f"{prefix}lines", lines)
    long = lambda x: x.cast("long")
    length = F.char_length(c(t))
    values = {
        "n_words": n,
        "word_chars": F.char_length(_without(c(t), SPACE)),
        "n_symbols": length - F.char_length(_without(c(t), _SYMBOLS)),
        "n_lines": F.size(f"{prefix}lines"),
        "n_dup_lines": F.size(f"{prefix}lines") - F.size(F.array_distinct(f"{prefix}lines")),
        "n_repeat_words": F.when(F.size(rep) > 0, F.size(covered)).otherwise(0),
        "n_upper": length - F.char_length(_without(c(t), "ABCDEFGHIJKLMNOPQRSTUVWXYZ")),
        "n_lower": length - F.char_length(_without(c(t), "abcdefghijklmnopqrstuvwxyz")),
        "n_exclamations": length - F.char_length(_without(c(t), "!")),
    }
    # Through a generator, because a filter on a measurement would else be pushed below all steps with their text put in.
    row = F.struct(*[long(v).alias(f"{prefix}{k}") for k, v in values.items()])
    return out.select(*[c(f"`{x}`") for x in docs.columns], F.inline(F.array(row)))


def _bits(prefix: str) -> Column:
    """The failed rules as bits of a long."""
    import re

    names = "|".join(("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_lower", "n_exclamations"))
    total: Column = F.lit(0).cast("long")
    for k, rule in enumerate(RULES.values()):
        total = total + F.when(F.expr(re.sub(rf"\b({names})\b", rf"{prefix}\1", rule)), F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long"))
    return total


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements and failed_bits of every whole text.

    Null and empty texts have no word and fail few_words. Repeated rows give repeated rows; other columns of
    ``docs`` aren't read. No shuffle and no Python: time and memory are linear in each text, but for one sort
    of its windows. Windows are compared by 64-bit hashes.
    """
    out = _measured(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), "text", "")
    return out.drop("text").withColumn("failed_bits", _bits(""))


def verdicts(rows: DataFrame, policy: str) -> DataFrame:
    """A ledger with ``kept`` under the policy."""
    return rows.withColumn("kept", F.col("failed_bits").bitwiseAND(F.lit(mask(policy)).cast("long")) == 0)


def ablation(rows: DataFrame) -> DataFrame:
    """policy, rule, n_failed (rows that fail the rule) and n_only (rows that no other rule of the policy rejects).

    From the stored bits, in one aggregation of one row; an empty ledger has zeros.
    """
    names, cells = list(RULES), []
    for version, rules in POLICIES.items():
        own = F.col("failed_bits").bitwiseAND(F.lit(mask(version)).cast("long"))
        for rule in rules:
            bit = F.lit(1 << names.index(rule)).cast("long")
            cells.append(F.struct(F.lit(version).alias("policy"), F.lit(rule).alias("rule"), F.count(F.when(own.bitwiseAND(bit) != 0, 1)).alias("n_failed"), F.count(F.when(own == bit, 1)).alias("n_only")))
    return rows.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def keep_by_rules(docs: DataFrame, policy: str = "v1") -> DataFrame:
    """The rows of ``docs``, with the same columns, that the policy keeps."""
    prefix = "kinlink_rules_"
    out = _measured(docs, "text", prefix)
    return out.where(_bits(prefix).bitwiseAND(F.lit(mask(policy)).cast("long")) == 0).select(*[F.col(f"`{x}`") for x in docs.columns])


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements and verdicts of every text of documents under policy v1."""
    out = verdicts(ledger(documents(spark, sf_dir)), "v1")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (F.col("failed_bits").bitwiseAND(F.lit(mask("base")).cast("long")) != 0).alias("base_failed"), "kept", "failed_bits")


def _sql_rules(source: str) -> str:
    """SQL for the ledger of ``source``, a table of documents, one row for each doc_id."""
    bits = " + ".join(f"CASE WHEN {rule} THEN {1 << k} ELSE 0 END" for k, rule in enumerate(RULES.values()))
    count = lambda characters: f"CAST(length(regexp_replace(t, '[^{characters}]', '', 'g')) AS BIGINT)"
    return f"""
    SELECT *, CAST({bits} AS BIGINT) AS failed_bits FROM (
      SELECT d.*, CAST(len(words) AS BIGINT) AS n_words,
        CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
        {count('#*$%&|<>')} AS n_symbols, {count('A-Z')} AS n_upper, {count('a-z')} AS n_lower, {count('!')} AS n_exclamations,
        CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
      FROM (SELECT *, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words,
              list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM {source}) d
      LEFT JOIN (
        SELECT doc_id, count(DISTINCT p + k) AS n FROM (
          SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, w1, w2, w3) AS c FROM (
            SELECT doc_id, p, words[p] AS w1, words[p + 1] AS w2, words[p + 2] AS w3 FROM (
              SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS p FROM (
                SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM {source})))) x,
          (VALUES (0), (1), (2)) o(k) WHERE c > 1 GROUP BY doc_id) r ON r.doc_id = d.doc_id) m"""


def rules_sql(source: str = "documents") -> str:
    """SQL for the documents, with their columns, that policy v1 keeps."""
    return f"SELECT doc_id, text, lang, source, n_chars FROM ({_sql_rules(source)}) WHERE (failed_bits & {mask('v1')}) = 0"


ORACLE = f"""SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (failed_bits & {mask('base')}) <> 0 AS base_failed, (failed_bits & {mask('v1')}) = 0 AS kept, failed_bits
FROM ({_sql_rules('documents')})"""
