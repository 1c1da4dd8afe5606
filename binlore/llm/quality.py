"""Host-level quality rules: rule failures by domain, rates shrunk with an empirical beta prior, verdicts joined back.

DataFrame functions only. Words are runs of characters other than ASCII white space. Lines and words are compared
exactly, word windows by 64-bit hashes inside one text.

A host's verdict has two steps. A rule binds at a host whose shrunk failure rate of it exceeds ``SUSPECT_RATE``: there
documents that fail it go, elsewhere one lone failure is forgiven (the base rules bind everywhere). A host whose shrunk rate of
any rule exceeds ``MAX_HOST_RATE`` is rejected whole.

Nulls: null or empty texts have no words and fail; a null host is a host of its own; a null id changes nothing. Whole texts
count, however long. Repeated rows count each; ties do not arise. Existing columns with the names of results are replaced. An
empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lookup_join, read_table, staged

SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A symbol to so many words, and duplicate lines to all lines with words, in percent, fail a document for its host's rates.
MAX_SYMBOL_PERCENT = 10
MAX_DUP_LINE_PERCENT = 30
#: A rule binds at a host if its shrunk failure rate there exceeds this.
SUSPECT_RATE = 0.05
#: A host is rejected if the shrunk failure rate of any rule exceeds this.
MAX_HOST_RATE = 0.5
#: Limits of the prior's strength (alpha + beta), in documents.
PRIOR_RANGE = (2.0, 10_000.0)
RULES = ["short", "repeats", "symbols", "dup_lines"]
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _let(value: Column, body) -> Column:
    """body(value) with value evaluated once."""
    return F.transform(F.array(value), body)[0]


def _covered(starts: Column, width: int) -> Column:
    """Positions covered by windows of ``width`` that begin at the ascending ``starts``."""
    n = F.size(starts)
    gaps = F.transform(starts, lambda s, i: F.when(i + 1 < n, F.least(F.lit(width), F.get(starts, i + 1) - s)).otherwise(width))
    return F.aggregate(gaps, F.lit(0), lambda a, g: a + g)


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more: hashed windows are sorted and neighbours compared."""
    def of(w: Column) -> Column:
        hashes = F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
        def repeated(h: Column) -> Column:
            order = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
            def starts(s: Column) -> Column:
                same = lambda x, i: (F.get(s, i - 1)["h"].eqNullSafe(x["h"])) | (F.get(s, i + 1)["h"].eqNullSafe(x["h"]))
                return F.sort_array(F.transform(F.filter(s, same), lambda x: x["i"]))
            return _let(_let(order, starts), lambda r: _covered(r, 3))
        return _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(repeated(h)))
    return _let(words, of)


def document_features(df: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """``df`` with the base columns (named ``prefix`` + name) and ``prefix + base_failed`` and ``prefix + fails`` (a flag for each rule)."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(t, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda s: F.length(F.translate(s, SPACES, "")) > 0)
    packed = _let(words, lambda w: F.struct(F.size(w).cast("bigint").alias("n"), F.when(F.size(w) < 4, 0).otherwise(_repeat_words(w)).cast("bigint").alias("r")))
    line_counts = _let(lines, lambda s: F.struct(F.size(s).alias("n"), (F.size(s) - F.size(F.array_distinct(s))).cast("bigint").alias("d")))
    p = lambda name: F.col(prefix + name)
    out = df.withColumn(prefix + "__w", packed).withColumn(prefix + "__l", line_counts)
    out = (
        out.withColumn(prefix + "n_words", p("__w")["n"])
        .withColumn(prefix + "word_chars", F.length(F.translate(t, SPACES, "")).cast("bigint"))
        .withColumn(prefix + "n_symbols", (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("bigint"))
        .withColumn(prefix + "n_dup_lines", p("__l")["d"])
        .withColumn(prefix + "n_repeat_words", p("__w")["r"])
    )
    repeats = 100 * p("n_repeat_words") > MAX_REPEAT_PERCENT * p("n_words")
    out = out.withColumn(prefix + "base_failed", (p("n_words") < MIN_WORDS) | repeats)
    fails = F.struct(
        (p("n_words") < MIN_WORDS).cast("int").alias("short"),
        repeats.cast("int").alias("repeats"),
        (100 * p("n_symbols") > MAX_SYMBOL_PERCENT * p("n_words")).cast("int").alias("symbols"),
        (100 * p("n_dup_lines") > MAX_DUP_LINE_PERCENT * p("__l")["n"]).cast("int").alias("dup_lines"),
    )
    return out.withColumn(prefix + "fails", fails).drop(prefix + "__w", prefix + "__l")


def host_rates(features: DataFrame, host: str, prefix: str = "") -> DataFrame:
    """One row per host (null included): documents and failures of each rule. Partial sums precede the shuffle."""
    return features.groupBy(F.col(host).alias("__bl_host")).agg(
        F.count("*").alias("n"), *[F.sum(F.col(prefix + "fails")[r]).alias(r) for r in RULES]
    )


def beta_priors(rates: DataFrame) -> dict[str, tuple[float, float]]:
    """(alpha, beta) of each rule by moments: pooled mean, and variance of the hosts' rates.

    With fewer than two hosts, or no variance, the prior has the largest strength.
    """
    row = rates.agg(
        F.sum("n").alias("n"), *[F.sum(r).alias(r) for r in RULES], *[F.var_pop(F.col(r) / F.col("n")).alias(f"v_{r}") for r in RULES]
    ).first()
    out = {}
    for r in RULES:
        mean = (row[r] or 0) / row["n"] if row["n"] else 0.0
        var = row[f"v_{r}"] or 0.0
        strength = mean * (1 - mean) / var - 1 if var > 0 else PRIOR_RANGE[1]
        strength = min(max(strength, PRIOR_RANGE[0]), PRIOR_RANGE[1])
        out[r] = (mean * strength, (1 - mean) * strength)
    return out


def host_verdicts(rates: DataFrame) -> DataFrame:
    """Per host: shrunk rates (``rate_<rule>``), ``binds`` (a flag for each rule) and ``host_ok``."""
    priors = beta_priors(rates)
    out = rates
    for r, (a, b) in priors.items():
        out = out.withColumn(f"rate_{r}", (F.col(r) + F.lit(a)) / (F.col("n") + F.lit(a + b)))
    out = out.withColumn("binds", F.struct(*[(F.col(f"rate_{r}") > SUSPECT_RATE).alias(r) for r in RULES]))
    return out.withColumn("host_ok", F.greatest(*[F.col(f"rate_{r}") for r in RULES]) <= MAX_HOST_RATE)


NULL_HOST = "\x00"


def with_verdicts(df: DataFrame, text: str = "text", host: str = "source", keep: list[str] | None = None, prefix: str = "") -> DataFrame:
    """Columns ``keep`` of ``df`` with the base columns, ``base_failed`` and ``kept``, each named with ``prefix``.

    A document is kept if it passes the base rules and those that bind at its host, and the host is not rejected. Features are
    staged once, so that texts are read and split one time only; the table goes when the session ends.
    """
    made = {prefix + c for c in [*BASE, "base_failed", "fails", "kept"]}
    keep = [c for c in (df.columns if keep is None else keep) if c not in made]
    features = document_features(df.withColumn("__bl_key", F.coalesce(F.col(host).cast("string"), F.lit(NULL_HOST))), text, prefix)
    features = staged(features.select(*keep, "__bl_key", *[prefix + c for c in [*BASE, "base_failed", "fails"]]), "quality")
    verdicts = host_verdicts(host_rates(features, "__bl_key", prefix)).select(F.col("__bl_host").alias("__bl_key"), F.col("host_ok").alias("__bl_ok"), F.col("binds").alias("__bl_binds"))
    joined = lookup_join(features, verdicts, "__bl_key", F.struct(*[F.col(prefix + c) for c in BASE]))
    bound = reduce(or_, [(F.col(prefix + "fails")[r] == 1) & F.col("__bl_binds")[r] for r in RULES])
    return joined.withColumn(prefix + "kept", ~F.col(prefix + "base_failed") & F.col("__bl_ok") & ~bound).drop("__bl_key", "__bl_ok", "__bl_binds")


def op9_host_rules(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return with_verdicts(docs, keep=["doc_id"]).select("doc_id", *BASE, "base_failed", "kept")


def stage_quality(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the rules reject go."""
    rated = with_verdicts(docs, prefix="__bl_q_")
    return rated.where("__bl_q_kept").select(*docs.columns)


#: The same rules in SQL; the prior's strength is computed as in ``beta_priors``.
def _oracle() -> str:
    low, high = PRIOR_RANGE
    rates = ", ".join(f"sum({r}) AS {r}" for r in RULES)
    prior = ", ".join(f"sum({r}) / sum(n) AS m_{r}, var_pop({r} / n) AS v_{r}" for r in RULES)
    strength = {r: f"least(greatest(CASE WHEN v_{r} > 0 THEN m_{r} * (1 - m_{r}) / v_{r} - 1 ELSE {high} END, {low}), {high})" for r in RULES}
    shrunk = {r: f"({r} + m_{r} * {strength[r]}) / (n + {strength[r]})" for r in RULES}
    binds = ", ".join(f"{shrunk[r]} > {SUSPECT_RATE} AS b_{r}" for r in RULES)
    bound = " OR ".join(f"{r} = 1 AND b_{r}" for r in RULES)
    symbols = "\\" + "\\".join(SYMBOLS)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, chr(0)) AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda s: regexp_matches(s, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
win AS (SELECT rid, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM w, unnest(range(1, len(w) - 1)) AS x(i)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS k FROM win) WHERE k > 1),
cov AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY rid),
f AS (SELECT rid, doc_id, host, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
      CAST(length(t) - length(regexp_replace(t, '[{symbols}]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
      CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines FROM w LEFT JOIN cov USING (rid)),
g AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed, CAST(n_words < {MIN_WORDS} AS INT) AS short, CAST(100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS INT) AS repeats,
      CAST(100 * n_symbols > {MAX_SYMBOL_PERCENT} * n_words AS INT) AS symbols, CAST(100 * n_dup_lines > {MAX_DUP_LINE_PERCENT} * n_lines AS INT) AS dup_lines FROM f),
h AS (SELECT host, count(*) AS n, {rates} FROM g GROUP BY host), p AS (SELECT {prior} FROM h),
v AS (SELECT host, greatest({", ".join(shrunk.values())}) <= {MAX_HOST_RATE} AS ok, {binds} FROM h, p)
SELECT doc_id, {", ".join(BASE)}, base_failed, NOT base_failed AND ok AND NOT ({bound}) AS kept FROM g JOIN v USING (host)
"""


ORACLE = _oracle()
