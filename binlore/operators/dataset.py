"""Dataset assembly: counts, exact samples, splits, balancing, features, metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FEATURES = ["ref_depth", "is_upward", "nb_referrers", "nb_strings", "nb_referees", "instructions", "lit_vec"]
#: Columns of the rows that the cascade is evaluated on.
PIPELINE_ROWS = ["binary", "func_addr", "token_literal", "names_func", "ref_depth", "is_upward", "nb_referrers", "nb_strings", "nb_referees", "instructions"]
#: Sample sizes up to this are a distributed top-n; larger ones go by a threshold.
TOP_ROWS = 10_000


def class_counts(df: DataFrame, label: str) -> DataFrame:
    """neg, pos, and how many positives are missing for balance."""
    neg = F.sum((F.col(label) == 0).cast("bigint"))
    return df.where(F.col(label).isNotNull()).agg(neg.alias("neg"), (F.count("*") - neg).alias("pos"), (2 * neg - F.count("*")).alias("missing"))


def _rank_key(keys: list[str], seed: int):
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def rank_threshold(df: DataFrame, keys: list[str], seed: int, want) -> str | None:
    """The hash of the ``want(rows)``-th row by key hashes, found by counting prefixes (65,536 at most) and then one prefix's rows.

    None if there is no such row.
    """
    hashed = df.select(_rank_key(keys, seed).alias("h"))
    rows = hashed.groupBy(F.substring("h", 1, 4).alias("p")).count().orderBy("p").collect()
    left = want(sum(r["count"] for r in rows))
    for r in rows:
        if 0 < left <= r["count"]:
            inside = Window.partitionBy("p").orderBy("h")
            cut = hashed.withColumn("p", F.substring("h", 1, 4)).where(F.col("p") == r["p"]).withColumn("k", F.row_number().over(inside))
            return cut.where(F.col("k") == left).first()["h"]
        left -= r["count"]
    return None


def exact_sample(df: DataFrame, keys: list[str], n: int, seed: int = 0) -> DataFrame:
    """Exactly ``n`` rows (all, if there are fewer): those with the smallest hash of their keys; no global sort."""
    h = _rank_key(keys, seed)
    if n <= TOP_ROWS:
        return df.orderBy(h, *keys).limit(n)
    last = rank_threshold(df, keys, seed, lambda rows: n)
    if last is None:
        return df
    below = df.where(h < F.lit(last))
    return below.unionByName(df.where(h == F.lit(last)).limit(n - below.count()))  # rows of one hash: equal keys


def holdout_split(df: DataFrame, keys: list[str], share: float = 0.2, seed: int = 0) -> DataFrame:
    """``df`` with ``is_test``: the ceil(share * n) rows of the smallest key hashes (unique keys assumed)."""
    last = rank_threshold(df, keys, seed, lambda rows: -(-rows * round(share * 1000) // 1000))
    return df.withColumn("is_test", _rank_key(keys, seed) <= F.lit(last or ""))


def balance(tokens: DataFrame, symbols: DataFrame, seed: int = 0) -> DataFrame:
    """Labelled tokens (literal, is_name) and as many sampled symbols as positives are missing."""
    missing = class_counts(tokens, "is_name").first()["missing"]
    if not missing or missing <= 0:
        raise ValueError("no positives are missing")
    if symbols.count() < missing:
        raise ValueError(f"{missing} positives are missing, and there are fewer symbols")
    extra = exact_sample(symbols.select("literal"), ["literal"], missing, seed).withColumn("is_name", F.lit(1))
    return tokens.where("is_name is not null").select("literal", "is_name").unionByName(extra)


def assemble_features(paths: DataFrame, token_paths: DataFrame, funcs: DataFrame) -> DataFrame:
    """Labelled token paths with their path's and function's numbers, by (binary, local id) and (binary, func_addr)."""
    rows = token_paths.where("names_func is not null").select("binary", F.col("local_path_id").alias("local_id"), "token_literal", "names_func")
    rows = rows.join(paths.where("to_name is not null").select("binary", "local_id", "func_addr", "ref_depth", "is_upward"), ["binary", "local_id"])
    return rows.join(funcs.select("binary", "func_addr", "nb_referrers", "nb_strings", "nb_referees", "instructions"), ["binary", "func_addr"])


def pipeline_rows(paths: DataFrame, token_paths: DataFrame, funcs: DataFrame) -> DataFrame:
    """The ten columns that the cascade is evaluated on."""
    return assemble_features(paths, token_paths, funcs).select(*PIPELINE_ROWS)


def group_in_functions(df: DataFrame) -> DataFrame:
    return df.groupBy("binary", "func_addr").agg(F.collect_list(F.struct(*[c for c in df.columns if c not in ("binary", "func_addr")])).alias("rows"))


def confusion(df: DataFrame, truth, prediction) -> DataFrame:
    """pos, neg, tp, tn, fp, fn and the scores; null where a denominator is zero, f1 0 if precision or recall is."""
    n = lambda c: F.coalesce(F.sum(c.cast("bigint")), F.lit(0))
    counts = df.agg(
        n(truth == 1).alias("pos"), n(truth == 0).alias("neg"), n((truth == 1) & prediction).alias("tp"), n((truth == 0) & ~prediction).alias("tn"),
        n((truth == 0) & prediction).alias("fp"), n((truth == 1) & ~prediction).alias("fn"),
    )
    share = lambda a, b: F.when(b > 0, a.cast("double") / b)
    c = F.col
    out = counts.withColumn("accuracy", share(c("tp") + c("tn"), c("pos") + c("neg")))
    out = out.withColumn("precision", share(c("tp"), c("tp") + c("fp"))).withColumn("recall", share(c("tp"), c("tp") + c("fn")))
    p, r = c("precision"), c("recall")
    return out.withColumn("f1", F.when(p.isNull() | r.isNull(), None).when((p == 0) | (r == 0), 0.0).otherwise(2 * p * r / (p + r)))


def seen_token_rate(test: DataFrame, train: DataFrame, literal: str = "literal") -> DataFrame:
    """Percent of the test rows whose token the training rows have; null for no test rows."""
    seen = train.select(literal).distinct().withColumn("__seen", F.lit(1))
    rate = test.join(seen, literal, "left").agg(F.count("__seen").alias("seen"), F.count("*").alias("total"))
    return rate.withColumn("percent", F.when(F.col("total") > 0, 100.0 * F.col("seen") / F.col("total")))


def job_counts(found: DataFrame, kept: DataFrame, label: str) -> DataFrame:
    """A job's counters: rows found, kept, left out as duplicates, and labelled among those kept."""
    kept_rows = kept.agg(F.count("*").alias("kept"), F.count(label).alias("labelled"))
    return found.agg(F.count("*").alias("found")).join(kept_rows).select("found", "kept", (F.col("found") - F.col("kept")).alias("duplicates"), "labelled")
