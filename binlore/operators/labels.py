"""Token jobs and label propagation. Updates become joins that give new tables; labels are null, 0 or 1, and null stays null."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import demangle, demangle_plain, is_noise_symbol, loosely_contains
from ..functions.tokenizer import tokenize, tokenize_udf
from .dedup import append_new, first_wins, last_wins

PAIR = ["path_id", "token_literal"]


def make_tokens(strings: DataFrame) -> DataFrame:
    """Unlabelled tokens of all strings; a token belongs to the first string that has it. ``strings``: seq, address, literal."""
    # a string's place among strings settles the order, whatever the token's place in it
    found = strings.select("seq", F.col("address").alias("string_addr"), F.explode(tokenize_udf("literal")).alias("t"))
    first = first_wins(found.select("string_addr", F.col("t.token").alias("literal"), "seq"), ["literal"], ["seq"])
    return first.select("string_addr", "literal", F.lit(None).cast("int").alias("is_name"))


#: New tokens that a task of ``token_counts`` holds before it gives them out.
HELD_TOKENS = 200_000


def token_counts(strings: DataFrame) -> DataFrame:
    """Of ``strings`` (seq, address, literal), each tokenized once: (string_addr, seq, tokens: their number, token: null) for every string,
    and (string_addr, seq, null, token) for the first string, by ``seq``, that has a token among those of a task."""
    schema = pa.schema([("string_addr", pa.int64()), ("seq", pa.int64()), ("tokens", pa.int64()), ("token", pa.string())])

    def run(batches):
        held: dict[str, tuple[int, int]] = {}

        def given():
            rows = list(held.values())
            columns = [[a for _, a in rows], [q for q, _ in rows], [None] * len(rows), list(held)]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        for batch in batches:
            seqs, addresses, literals = (batch.column(i) for i in range(3))
            sizes = []
            for seq, address, literal in zip(seqs.to_pylist(), addresses.to_pylist(), literals):
                found = tokenize(literal.as_py())
                sizes.append(len(found))
                here = (seq, address)
                for token in {t for t, _ in found}:
                    if held.setdefault(token, here)[0] > seq:
                        held[token] = here
            yield pa.RecordBatch.from_arrays([addresses.cast(pa.int64()), seqs.cast(pa.int64()), pa.array(sizes, pa.int64()), pa.nulls(len(sizes), pa.string())], schema=schema)
            if len(held) >= HELD_TOKENS:
                yield given()
        yield given()

    return strings.select("seq", "address", "literal").mapInArrow(run, "string_addr long, seq long, tokens long, token string")


def add_tokens_of(tokens: DataFrame, strings: DataFrame, address: int) -> DataFrame:
    """``tokens`` with the new tokens of one string."""
    if not address:
        raise ValueError("address 0 names no string")
    one = strings.where(F.col("address") == address).limit(1).select("address", F.posexplode(tokenize_udf("literal")).alias("pos", "t"))
    rows = one.select(F.col("address").alias("string_addr"), F.col("t.token").alias("literal"), F.lit(None).cast("int").alias("is_name"), "pos")
    return tokens.unionByName(append_new(tokens, rows, ["literal"], ["pos"]).drop("pos"))


def load_symbols(symbols: DataFrame) -> DataFrame:
    """Symbols (seq, name, address) to pdb rows: noise dropped, names demangled, empty mangled names dropped, first literal wins.

    Symbols with an unknown special code are left out; ``rejected_symbols`` gives them.
    """
    clean = symbols.where(~is_noise_symbol(F.col("name")))
    mangled = F.col("name").startswith("?")
    rows = clean.select(
        F.col("address").alias("func_addr"), F.when(mangled, demangle(F.col("name"))).otherwise(demangle_plain(F.col("name"))).alias("literal"), mangled.cast("int").alias("demangled"), "seq"
    )
    rows = rows.where(F.col("literal").isNotNull() & ~((F.col("demangled") == 1) & (F.col("literal") == "")))
    return first_wins(rows, ["literal"], ["seq"]).drop("seq")


def rejected_symbols(symbols: DataFrame) -> DataFrame:
    return symbols.where(~is_noise_symbol(F.col("name")) & F.col("name").startswith("?") & demangle(F.col("name")).isNull())


def autolabel_paths(tokens: DataFrame, paths: DataFrame, pdb: DataFrame) -> DataFrame:
    """``paths`` with to_name 1 where a positive token of its string is loosely contained in a symbol of its function.

    Both keys are equi-joins; the containment is what remains to test.
    """
    positive = tokens.where("is_name = 1").select("string_addr", F.col("literal").alias("token"))
    symbols = pdb.select("func_addr", F.col("literal").alias("symbol"))
    pairs = paths.select("id", "func_addr", "string_addr").join(positive, "string_addr").join(symbols, "func_addr")
    hit = pairs.where(loosely_contains(F.col("symbol"), F.col("token"))).select("id").distinct().withColumn("__hit", F.lit(True))
    return paths.join(hit, "id", "left").withColumn("to_name", F.when(F.col("__hit"), 1).otherwise(F.col("to_name"))).select(*paths.columns)


def positive_paths(tokens: DataFrame, paths: DataFrame) -> DataFrame:
    """A row for each positive token and positive path of one string."""
    return tokens.where("is_name = 1").select("string_addr", F.col("literal").alias("token_literal")).join(paths.where("to_name = 1"), "string_addr")


def paths_of_positive_functions(tokens: DataFrame, paths: DataFrame) -> DataFrame:
    """A string's positive tokens count once, so that they don't multiply its paths."""
    strings = tokens.where("is_name = 1").select("string_addr").distinct()
    return paths.join(paths.where("to_name = 1").join(strings, "string_addr", "left_semi").select("func_addr").distinct(), "func_addr", "left_semi")


def paths_without_tokens(paths: DataFrame, token_paths: DataFrame, to_name: int) -> DataFrame:
    """Labelled paths that no token path names."""
    return paths.where(F.col("to_name") == to_name).join(token_paths, F.col("id") == F.col("path_id"), "left_anti")


def explode_paths(paths: DataFrame, strings: DataFrame, label: int | None) -> DataFrame:
    """Token paths of ``paths``: each path's string tokenized, one row a token; paths without a string give none.

    Strings are tokenized once each, before they meet their paths.
    """
    need = strings.join(paths.select(F.col("string_addr").alias("address")).distinct(), "address", "left_semi")
    tokens = need.select(F.col("address").alias("string_addr"), F.explode(tokenize_udf("literal")).alias("t"))
    return paths.join(tokens, "string_addr").select(F.col("id").alias("path_id"), "func_addr", "string_addr", F.col("t.token").alias("token_literal"), F.lit(label).cast("int").alias("names_func"))


def token_paths(tokens: DataFrame, paths: DataFrame, strings: DataFrame) -> DataFrame:
    return explode_paths(paths_of_positive_functions(tokens, paths), strings, None)


def token_path_ids(tokens: DataFrame, paths: DataFrame, strings: DataFrame) -> DataFrame:
    """``path_id`` of the paths that ``token_paths`` names, without a row for each token."""
    some = strings.where(F.size(tokenize_udf("literal")) > 0).select(F.col("address").alias("string_addr"))
    return paths_of_positive_functions(tokens, paths).join(some, "string_addr", "left_semi").select(F.col("id").alias("path_id"))


def token_paths_positive(tokens: DataFrame, paths: DataFrame, strings: DataFrame) -> DataFrame:
    """As often as a path has positive tokens."""
    return explode_paths(positive_paths(tokens, paths), strings, None)


def token_paths_negative(paths: DataFrame, known: DataFrame, strings: DataFrame) -> DataFrame:
    return explode_paths(paths_without_tokens(paths, known, 0), strings, 0)


def token_paths_missing_positive(paths: DataFrame, known: DataFrame, strings: DataFrame) -> DataFrame:
    return explode_paths(paths_without_tokens(paths, known, 1), strings, None)


def token_paths_of_one(paths: DataFrame, strings: DataFrame, path_id: int) -> DataFrame:
    return explode_paths(paths.where(F.col("id") == path_id).limit(1), strings, None)


def add_one_missing(tokens: DataFrame, known: DataFrame, paths: DataFrame, strings: DataFrame, path_id) -> tuple[DataFrame, DataFrame]:
    """``tokens`` with the new tokens of one path's string, and ``known`` token paths with all of that path's (which are always added)."""
    path = paths.where(F.col("id") == path_id).limit(1)
    one = strings.join(path.select(F.col("string_addr").alias("address")), "address", "left_semi").select("address", F.posexplode(tokenize_udf("literal")).alias("pos", "t"))
    rows = one.select(F.col("address").alias("string_addr"), F.col("t.token").alias("literal"), F.lit(None).cast("int").alias("is_name"), "pos")
    more = append_new(tokens, rows, ["literal"], ["pos"]).drop("pos")
    return tokens.unionByName(more), known.unionByName(explode_paths(path, strings, None))


def merge_positive(known: DataFrame, helper: DataFrame, seq: str = "seq") -> DataFrame:
    """``known`` with the helper's labels by (path_id, token_literal); its last row of a key wins, nulls too."""
    last = last_wins(helper.select(*PAIR, "names_func", seq), PAIR, [seq]).select(*PAIR, F.col("names_func").alias("__label"), F.lit(True).alias("__hit"))
    return known.join(last, PAIR, "left").withColumn("names_func", F.when(F.col("__hit"), F.col("__label")).otherwise(F.col("names_func"))).select(*known.columns)


def _set_by_pair(known: DataFrame, pairs: DataFrame, label: int | None) -> DataFrame:
    hit = pairs.select(*PAIR).distinct().withColumn("__hit", F.lit(True))
    return known.join(hit, PAIR, "left").withColumn("names_func", F.when(F.col("__hit"), F.lit(label).cast("int")).otherwise(F.col("names_func"))).select(*known.columns)


def label_negative(known: DataFrame, paths: DataFrame) -> DataFrame:
    """0 for every row of a pair that has an unlabelled row under a negative path."""
    negative = paths.where("to_name = 0").select(F.col("id").alias("path_id"))
    return _set_by_pair(known, known.where("names_func is null").join(negative, "path_id", "left_semi"), 0)


def cleanse_labels(known: DataFrame, paths: DataFrame) -> DataFrame:
    """Null for every row of a pair that has a labelled row without a labelled path."""
    labelled = paths.where("to_name is not null").select(F.col("id").alias("path_id"))
    return _set_by_pair(known, known.where("names_func is not null").join(labelled, "path_id", "left_anti"), None)


# ---- token paths grouped by path: the columns of a path and ``rows``, an array of (token_literal, names_func) with all rows of the
# path. Ids are unique, so the rows of a pair are in one array and the updates above need no join and no shuffle.


def tokens_by_string(strings: DataFrame, wanted: DataFrame) -> DataFrame:
    """(string_addr, tokens) of the strings whose addresses ``wanted`` (string_addr) has, an array for each string."""
    need = strings.join(wanted.select(F.col("string_addr").alias("address")).distinct(), "address", "left_semi")
    return need.select(F.col("address").alias("string_addr"), tokenize_udf("literal").alias("t")).select("string_addr", F.col("t.token").alias("tokens"))


def token_rows(tokens: Column, label: Column) -> Column:
    """``rows`` of a path from the tokens of its string, all with one label."""
    return F.transform(tokens, lambda t: F.struct(t.alias("token_literal"), label.cast("int").alias("names_func")))


def _with(value: Column, then) -> Column:
    """``then(value)``, with ``value`` computed once however often it is used, lambdas included."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _relabelled(rows: Column, where, label: int | None) -> Column:
    """``rows`` with ``label`` in every row whose token has a row that ``where`` holds of."""
    hits = F.transform(F.filter(rows, where), lambda r: r["token_literal"])
    new = lambda r, hit: F.when(F.array_contains(hit, r["token_literal"]), F.lit(label).cast("int")).otherwise(r["names_func"])
    return _with(
        F.struct(rows.alias("rows"), hits.alias("hits")),
        lambda x: F.transform(x["rows"], lambda r: F.struct(r["token_literal"].alias("token_literal"), new(r, x["hits"]).alias("names_func"))),
    )


def merge_positive_grouped(known: DataFrame, helper: Column, has: Column) -> DataFrame:
    """``merge_positive`` where the path's helper rows are an array of (token_literal, names_func, seq); ``has``: there are some."""
    def last(r, rows):
        return F.array_max(F.transform(F.filter(rows, lambda h: h["token_literal"] == r["token_literal"]), lambda h: F.struct(h["seq"], h["names_func"])))

    def merged(x):
        found = F.transform(x["rows"], lambda r: F.struct(r.alias("row"), last(r, x["helper"]).alias("last")))
        label = lambda y: F.when(y["last"].isNotNull(), y["last"]["names_func"]).otherwise(y["row"]["names_func"])
        return F.transform(found, lambda y: F.struct(y["row"]["token_literal"].alias("token_literal"), label(y).alias("names_func")))

    rows = _with(F.struct(F.col("rows"), helper.alias("helper")), merged)
    return known.withColumn("rows", F.when(has, rows).otherwise(F.col("rows")))


def label_negative_grouped(known: DataFrame) -> DataFrame:
    rows = _relabelled(F.col("rows"), lambda r: r["names_func"].isNull(), 0)
    return known.withColumn("rows", F.when(F.col("to_name") == 0, rows).otherwise(F.col("rows")))


def cleanse_labels_grouped(known: DataFrame) -> DataFrame:
    rows = _relabelled(F.col("rows"), lambda r: r["names_func"].isNotNull(), None)
    return known.withColumn("rows", F.when(F.col("to_name").isNull(), rows).otherwise(F.col("rows")))


def ungrouped(known: DataFrame, *columns: str) -> DataFrame:
    """A row for each of ``rows``, behind ``columns`` of the path; paths without rows give none."""
    # the plain explode would test the arrays inside the joins below too, and so compute them twice
    return known.select(*columns, F.explode_outer("rows").alias("r")).where("r is not null").select(*columns, "r.token_literal", "r.names_func")
