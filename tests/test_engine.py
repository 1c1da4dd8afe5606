"""Reference operators: golden traces, rules with defined order, and every query against its SQL."""

import json
import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from binlore.functions import tokenizer
from binlore.functions.text import demangle, demangle_plain, escape_literal, loosely_contains
from binlore.functions.tokenizer import tokenize, tokenize_udf
from binlore.operators import dataset, graph, labels, ml
from binlore.operators.dedup import first_wins, last_wins, two_key_first_wins
from binlore.plans import queries as plans
from binlore.sources import io, staging
from binlore.sources.schemas import STRINGS, TABLES, TOKENS, check_columns

SF = "/root/testdata/sf0.001"
R, C, X, P, I, N = "REGULAR_LIKE", "CONSTRUCTOR_LIKE", "DESTRUCTOR_LIKE", "OPERATOR_LIKE", "IDENTIFIER_LIKE", "NUMBER_LIKE"


@pytest.mark.parametrize(
    "text, want",
    [
        ("", []), ("Foo::Bar", [("Foo::Bar", R)]), ("Foo::Foo", [("Foo::Foo", C)]), ("ns::Foo::~Foo", [("ns::Foo::~Foo", X)]),
        ("V<int>::operator->", [("V<int>::operator->", P)]), ("V<int>::Add", [("V<int>::Add", R)]), ("hello world", [("hello", R), ("world", R)]),
        ("C:\\Program Files\\x.dll", [("C:\\Program", I), ("Files\\x.dll", I)]), ("foo\\nBar", [("foo\\nBar", I)]), ("operator>>", [("operator", R)]),
        ("operator><", [("operator><", P)]), ("operator 5 x", [("5", N), ("x", R)]), ("hello wörld foo", [("hello", R)]), ("a<b><c> z", [("a<b><c>", R), ("<c>", "TEMPLATE_LIKE")]),
        ("http://a.example.org/es/12?utm_source=feed", [("http", R), ("//a.example.org/es/12", I), ("utm_source", R), ("feed", R)]),
        ("lib::box<lib::duo<char,int> >::box<lib::duo<char,int> >", [("lib::box<lib::duo<char,int> >::box<lib::duo<char,int> >", C)]),
        ("Grid<Cell<Key>,Less<7,Tag<2> > const >::operator->", [("Grid<Cell<Key>,Less<7,Tag<2> > const >::operator->", P)]),
        ("lib::bag<lib::rule>::~bag<lib::rule>", [("lib::bag<lib::rule>::~bag<lib::rule>", X)]),
    ],
)
def test_tokenizer(text, want):
    assert tokenize(text) == want


def test_tokenizer_shortcut_equals_all_steps():
    """Strings without templates, scopes and operators skip steps that cannot change them."""
    r = random.Random(0)
    pieces = ["a", "foo", "Bar9", "9", "²", "é", "日", "/", "\\", "\\n", " ", ".", ":", "<", "~", "new", "delete", "-", "\x01", "\t", "[", "]", "_x", "::", ">", "operator", "٣"]
    for _ in range(5000):
        text = "".join(r.choice(pieces) for _ in range(r.randint(1, 14)))
        state = tokenizer.lex(text)
        for step in (tokenizer.join_operators, tokenizer.join_templates, tokenizer.match_names, tokenizer.join_paths):
            state = step(*state)
        assert tokenize(text) == tokenizer.split_tokens(*state), text


def test_tokenizer_is_linear_on_long_texts():
    assert len(tokenize("word < > " * 20_000)) == 40_000  # a word and a bracketed space each time


def test_tokenizer_column(spark):
    texts = [None, "", "Foo::Bar", "x y", "é"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", tokenize_udf("t").alias("k")).orderBy("i").collect()
    assert [[tuple(x) for x in r.k] for r in got] == [tokenize(t) for t in texts]


def test_text_functions(spark):
    rows = [("?f@A@B@@QAE", "B::A::f"), ("??0Foo@ns@@QAE", "ns::Foo::Foo"), ("??1Foo@@", "Foo::~Foo"), ("??_VFoo@@", "Foo::operator delete[]"), ("??AFoo@@", "Foo::operator[]"), ("??BFoo@@", ""), ("??zFoo@@", None), ("??$f@H@@", "H::f"), ("??$?0f@@", ""), ("??0?$V@H@@", "H::V::V")]
    df = spark.createDataFrame(rows, "name string, want string")
    assert df.where(~demangle(F.col("name")).eqNullSafe(F.col("want"))).count() == 0
    one = spark.range(1).select(demangle_plain(F.lit("f@12")).alias("a"), escape_literal(F.lit("a\\\t\x1b\n")).alias("b"), loosely_contains(F.lit("xFooXBar"), F.lit("foo_bar")).alias("c"), loosely_contains(F.lit("ÀB"), F.lit("àb")).alias("d"), loosely_contains(F.lit("a\\b"), F.lit("A\\B")).alias("e")).first()
    assert tuple(one) == ("f", "a\\\\\\t\\x1B\\n", True, False, True)


def test_first_and_last_wins(spark):
    df = spark.createDataFrame([(1, "x", 2), (2, "x", 1), (3, "y", 1)], "v int, k string, seq int")
    assert {(r.k, r.v) for r in first_wins(df, ["k"], ["seq"]).collect()} == {("x", 2), ("y", 3)}
    assert {(r.k, r.v) for r in last_wins(df, ["k"], ["seq"]).collect()} == {("x", 1), ("y", 3)}
    assert {(r.k, r.v) for r in first_wins(df, ["k"], ["seq", "v"]).collect()} == {("x", 2), ("y", 3)}


def test_two_keys_first_wins(spark):
    r = random.Random(1)
    for keys in (6, 40):
        rows = [(k, r.randrange(keys), f"l{r.randrange(keys)}") for k in range(60)]
        kept, first, second = [], set(), set()
        for k, a, b in rows:
            if a not in first and b not in second:
                kept.append(k)
                first.add(a)
                second.add(b)
        df = spark.createDataFrame(rows, "seq long, address long, literal string")
        assert sorted(x.seq for x in two_key_first_wins(df, "address", "literal", "seq").collect()) == kept
    assert two_key_first_wins(df.limit(0), "address", "literal", "seq").count() == 0


def test_string_export(spark):
    rows = [(0, 1, "x"), (1, 1, "y"), (2, 2, "y"), (3, 3, "x"), (4, 4, "")]
    raw = spark.createDataFrame([(k, a, t.encode("utf-16-le")) for k, a, t in rows], "seq long, address long, bytes binary")
    assert sorted(tuple(r) for r in graph.export_strings(raw).collect()) == [(1, "x"), (2, "y")]


def test_paths_prefer_down_over_up(spark):
    code = spark.createDataFrame([(10, 1, 2), (11, 2, 1), (12, 1, 9)], "frm_site long, frm_func long, to long")
    data = spark.createDataFrame([(1, 100), (2, 200)], "frm_func long, to long")
    got = {tuple(r) for r in graph.xref_paths(code, data, spark.createDataFrame([(9,)], "func long")).select("func_addr", "string_addr", "path_func1", "path_func2", "ref_depth", "is_upward").collect()}
    assert (1, 200, 2, -1, 1, 0) in got and (1, 200, 2, -1, 1, 1) not in got and (1, 100, 2, 1, 2, 0) in got and not any(9 in r[2:4] for r in got)


def test_references_resolve_by_function_bounds(spark):
    bounds = spark.createDataFrame([(100, 110), (110, 9000), (10_000, 10_001)], "func_addr long, func_end long")
    refs = spark.createDataFrame([(x,) for x in (99, 100, 109, 110, 5000, 8999, 9000, 10_000, 10_001)], "to long")
    assert {r.to: r.inside for r in graph.functions_around(refs, bounds).collect()} == {100: 100, 109: 100, 110: 110, 5000: 110, 8999: 110, 10_000: 10_000}
    code = spark.createDataFrame([(1, 100, 5000), (2, 110, 10_000), (3, 100, 9999)], "frm_site long, frm_func long, to long")
    data = spark.createDataFrame([(110, 7), (10_000, 8)], "frm_func long, to long")
    got = {tuple(r) for r in graph.xref_paths(code, data, None, bounds).select("func_addr", "string_addr", "path_func1", "path_func2", "ref_depth", "is_upward").collect()}
    # the call into the middle of 110 counts downwards with its own target, and is no caller of its start
    assert got == {(110, 7, -1, -1, 0, 0), (10_000, 8, -1, -1, 0, 0), (100, 7, 5000, -1, 1, 0), (110, 8, 10_000, -1, 1, 0), (100, 8, 5000, 10_000, 2, 0), (10_000, 7, 110, -1, 1, 1)}


def test_label_updates_go_by_key_and_keep_nulls(spark):
    known = spark.createDataFrame([("p", 1, 1, "t", 1), ("p", 1, 1, "t", None), ("q", 1, 1, "t", None)], "path_id string, func_addr long, string_addr long, token_literal string, names_func int")
    paths = spark.createDataFrame([("p", 0), ("q", None)], "id string, to_name int")
    assert sorted((r.path_id, r.names_func) for r in labels.label_negative(known, paths).collect() if r.names_func is not None) == [("p", 0), ("p", 0)]
    assert all(r.names_func is None for r in labels.cleanse_labels(known, paths.where("id = 'q'")).collect())
    helper = spark.createDataFrame([("p", "t", 1, 1), ("p", "t", None, 2)], "path_id string, token_literal string, names_func int, seq int")
    assert all(r.names_func is None for r in labels.merge_positive(known, helper).collect())


def test_grouped_label_updates_equal_those_by_key(spark):
    paths = spark.createDataFrame([("p", 0), ("q", 1), ("r", None), ("e", 0)], "id string, to_name int")
    row = "path_id string, to_name int, rows array<struct<token_literal:string,names_func:int>>, helper array<struct<token_literal:string,names_func:int,seq:long>>"
    grouped = spark.createDataFrame([
        ("p", 0, [("a", None), ("a", 1), ("b", 1), (None, None)], [("a", 1, 1), ("a", None, 2), ("z", 1, 1)]), ("q", 1, [("a", None), ("b", 0)], [("b", 0, 3), ("b", 1, 4)]),
        ("r", None, [("a", 1), ("a", None), ("c", None)], None), ("e", 0, [], []),
    ], row)
    known = labels.ungrouped(grouped, "path_id")
    assert known.count() == 9
    helper = grouped.select("path_id", F.inline("helper"))
    key = lambda df: sorted(map(str, df.select("path_id", "token_literal", "names_func").collect()))
    flat = lambda df: key(labels.ungrouped(df, "path_id"))
    assert flat(labels.label_negative_grouped(grouped)) == key(labels.label_negative(known, paths)) != key(known)
    assert flat(labels.cleanse_labels_grouped(grouped)) == key(labels.cleanse_labels(known, paths)) != key(known)
    assert flat(labels.merge_positive_grouped(grouped, F.col("helper"), F.col("path_id") != "r")) == key(labels.merge_positive(known, helper)) != key(known)


@pytest.mark.parametrize("name", ["merge_pos_labels", "label_negatives", "cleanse_labels"])
def test_label_queries_shuffle_no_token_paths(spark, name):
    """Nothing is staged, and no exchange carries a path's id or its tokens one by one."""
    plan = plans.Q[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "token-paths" not in plan
    for line in plan.split("\n"):
        assert "Join" not in line or "path_id" not in line and "token_literal" not in line


def test_paths_with_attributes_and_of_some_functions(spark):
    code = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (3, 3), (3, 4), (1, 2), (None, 2), (4, None)], "frm_func long, to long")
    data = spark.createDataFrame([(1, 10), (2, 20), (3, 30), (4, 10)], "frm_func long, to long")
    marks = spark.createDataFrame([(10, "x"), (30, "y")], "string_addr long, mark string")
    key = lambda df: sorted(map(str, df.select(*graph.KEY, "ref_depth", "is_upward").collect()))
    plain, marked = graph.xref_paths(code, data), graph.xref_paths(code, data, attributes=marks)
    assert key(plain) == key(marked) and len(key(plain)) == len(set(key(plain)))
    assert {(r.string_addr, r.mark) for r in marked.collect()} == {(10, "x"), (20, None), (30, "y")}
    ups = {(r.func_addr, r.path_func1) for r in plain.where("is_upward = 1").collect()}
    assert ups == {(3, 2), (4, 3)}  # 1 and 2 call each other and 3 itself, so these are found downwards
    assert plain.where("func_addr is null and ref_depth = 1").count() == 1
    some = spark.createDataFrame([(1,), (3,)], "func_addr long")
    assert key(graph.xref_paths(code, data, functions=some)) == key(plain.where("func_addr in (1, 3)"))


def test_token_jobs(spark):
    strings = spark.createDataFrame([(1, 5, "a b"), (2, 6, "b c::d"), (3, 7, None)], "seq long, address long, literal string")
    first = labels.make_tokens(strings)
    assert {(r.literal, r.string_addr) for r in first.collect()} == {("a", 5), ("b", 5), ("c::d", 6)}
    assert labels.add_tokens_of(first.where("literal <> 'c::d'"), strings, 6).count() == 3
    with pytest.raises(ValueError):
        labels.add_tokens_of(first, strings, 0)
    paths = spark.createDataFrame([(1, 10, 6, 1), (2, 10, 7, 1), (3, 11, 5, 0)], "id long, func_addr long, string_addr long, to_name int")
    tokens = first.withColumn("is_name", F.when(F.col("literal") == "c::d", 1))
    ids = {r.path_id for r in labels.token_path_ids(tokens, paths, strings).collect()}
    assert ids == {r.path_id for r in labels.token_paths(tokens, paths, strings).select("path_id").collect()} == {1}
    known = labels.token_paths(tokens, paths, strings)
    more, rows = labels.add_one_missing(first.where("literal = 'a'"), known, paths, strings, 3)
    assert {r.literal for r in more.collect()} == {"a", "b"} and rows.count() == known.count() + 2


def test_dataset_and_metrics(spark):
    df = spark.range(1000)
    split = dataset.holdout_split(df, ["id"])
    assert split.where("is_test").count() == 200 and dataset.exact_sample(df, ["id"], 37).distinct().count() == 37
    none = dataset.confusion(spark.createDataFrame([], "t int, p boolean"), F.col("t"), F.col("p")).first()
    assert none.pos == 0 and none.accuracy is None and none.f1 is None
    tokens = spark.createDataFrame([("a", 1), ("b", 0), ("c", 0)], "literal string, is_name int")
    assert dataset.balance(tokens, spark.createDataFrame([("x",), ("y",)], "literal string")).where("is_name = 1").count() == 2
    with pytest.raises(ValueError, match="fewer symbols"):
        dataset.balance(tokens.where("is_name = 0"), tokens.select("literal").limit(1))
    with pytest.raises(ValueError):
        check_columns(tokens, STRINGS)
    assert check_columns(tokens.withColumn("string_addr", F.lit(1).cast("long")), TOKENS).count() == 3


def test_large_samples_go_by_threshold(spark, monkeypatch):
    df = spark.range(3000).select((F.col("id") % 2000).alias("k"))  # some keys twice
    want = sorted(r.k for r in dataset.exact_sample(df, ["k"], 500).collect())
    monkeypatch.setattr(dataset, "TOP_ROWS", 10)
    assert sorted(r.k for r in dataset.exact_sample(df, ["k"], 500).collect()) == want
    assert dataset.exact_sample(df, ["k"], 5000).count() == 3000 and dataset.exact_sample(df.limit(0), ["k"], 500).count() == 0


def test_sources(spark, tmp_path):
    (tmp_path / "s.json").write_text('[{"name": "?f@@", "address": 3}, {"name": "g@1", "address": 2}]')
    assert [tuple(r) for r in io.read_symbols(spark, str(tmp_path / "s.json")).orderBy("seq").collect()] == [(0, "?f@@", 3), (1, "g@1", 2)]
    (tmp_path / "m.json").write_text('{"outputFile": "o", "files": [{"label": "a", "path": "x"}, {"label": "b", "path": "y"}]}')
    assert [r.label for r in io.read_merge_config(spark, str(tmp_path / "m.json")).orderBy("position").collect()] == ["a", "b"]
    with pytest.raises(Exception, match="null in v"):
        io.require(spark.createDataFrame([(None,)], "v int"), ["v"]).collect()
    spark.createDataFrame([(".idata", 1, 2)], "name string, ea long, size long").write.parquet(f"{tmp_path}/segments")
    assert io.read_input(spark, str(tmp_path), "segments").count() == 1
    io.drop_table(spark, f"{tmp_path}/segments")
    assert not os.path.exists(f"{tmp_path}/segments")


def test_results_tables(spark, tmp_path):
    scores = dataset.confusion(spark.createDataFrame([(1, True), (0, True)], "t int, p boolean"), F.col("t"), F.col("p"))
    name = ml.model_name("models/names/k-nn.v2.model")
    assert name == "k_nn"
    for _ in range(2):
        io.save_results(scores, str(tmp_path), name)
    got = io.read_results(spark, str(tmp_path), [name]).collect()
    assert len(got) == 1 and (got[0].model, got[0].tp, got[0].fp, got[0].precision) == ("k_nn", 1, 1, 0.5)


def test_staging_needs_a_named_folder_on_a_cluster(spark):
    assert staging.shared_dir(spark)

    class Cluster:
        class conf:
            get = staticmethod(lambda k, v=None: v)

        class sparkContext:
            master = "spark://host:7077"
            getConf = staticmethod(lambda: {})

    with pytest.raises(RuntimeError):
        staging.shared_dir(Cluster)


def test_merge_job(spark, tmp_path):
    for label, first in (("a", 7), ("b", 3)):
        for name, schema in TABLES.items():
            row = {f.name: "t" if f.dataType.simpleString() == "string" else 1 for f in schema}
            row |= {"id": first} if name == "paths" else {}
            rows = [tuple(row.values())] if name != "paths" else [tuple((row | {"id": i}).values()) for i in (first + 1, first)]
            io.append(spark.createDataFrame(rows, schema), f"{tmp_path}/{label}/{name}")
    files = [{"label": x, "path": f"{tmp_path}/{x}"} for x in "ba"]
    (tmp_path / "m.json").write_text(json.dumps({"outputFile": f"{tmp_path}/out", "files": files}))
    out = io.merge_job(spark, str(tmp_path / "m.json"))
    paths = spark.read.parquet(f"{out}/paths")
    assert [(r.id, r.binary, r.local_id) for r in paths.orderBy("id").collect()] == [(1, "b", 3), (2, "b", 4), (3, "a", 7), (4, "a", 8)]
    assert "id" not in spark.read.parquet(f"{out}/funcs").columns and "local_path_id" in spark.read.parquet(f"{out}/token_paths").columns
    io.append(spark.createDataFrame([(1, None)], TABLES["strings"]), f"{tmp_path}/a/strings")
    with pytest.raises(Exception, match="null in literal"):
        io.merge_job(spark, str(tmp_path / "m.json"))


def test_missing_strings_are_exported_once(spark):
    paths = spark.createDataFrame([(1,), (2,), (3,), (4,), (5,)], "string_addr long")
    have = spark.createDataFrame([(1, "a")], "address long, literal string")
    raw = spark.createDataFrame([(0, 2, "b\n".encode("utf-16-le")), (1, 3, "b\n".encode("utf-16-le")), (2, 4, b""), (3, 5, "a".encode("utf-16-le")), (4, 9, "c".encode("utf-16-le"))], "seq long, address long, bytes binary")
    assert [tuple(r) for r in graph.export_missing_strings(paths, have, raw).collect()] == [(2, "b\\n")]


@pytest.fixture(scope="module")
def points(spark):
    rows = spark.range(400).select("id", (F.col("id") % 20).cast("double").alias("x"), (F.rand(1) * 0.1).alias("z")).withColumn("y", (F.col("x") > 9).cast("int"))
    return ml.training_rows(rows, ["x", "z"], "y", ["id"])


@pytest.mark.parametrize("kind", ml.KINDS)
def test_models(spark, points, kind, tmp_path):
    model = ml.train(points, kind, ["x", "z"], "y")
    found = model.predict(points.withColumn("other", F.lit("stays")), "p")
    assert {"other", "p", "p_prob"} < set(found.columns)
    assert dataset.confusion(found, F.col("y"), F.col("p") == 1).first().accuracy > 0.8
    model.save(spark, f"{tmp_path}/{kind}")
    again = type(model).load(spark, f"{tmp_path}/{kind}").predict(points, "p")
    assert again.select(F.sum("p")).first()[0] == found.select(F.sum("p")).first()[0]


def test_training_rows_are_bounded(spark):
    assert ml.training_rows(spark.range(500).selectExpr("id", "id * 1.0 as x", "id % 2 as y"), ["x"], "y", ["id"], limit=50).count() == 50


def test_nearest_neighbours(spark):
    known = spark.createDataFrame([(0.0, 1), (2.0, 0), (2.0, 1), (9.0, 1)], "x double, y int")
    asked = spark.createDataFrame([(1, 1.0), (2, 8.0)], "i long, x double")
    assert {(r.i, r.p) for r in ml.NearestNeighbours(["x"], 1).fit(known, "y").predict(asked, "p").collect()} == {(1, 0), (2, 1)}  # of equal distances the smaller label
    r = np.random.default_rng(0)
    x, y, q = r.normal(size=(80, 2)), r.integers(0, 2, 80), r.normal(size=(30, 2))
    model = ml.NearestNeighbours(["a", "b"], 5).fit(spark.createDataFrame([(*p, int(c)) for p, c in zip(x.tolist(), y)], "a double, b double, y int"), "y")
    got = [v.p for v in model.predict(spark.createDataFrame([(i, *p) for i, p in enumerate(q.tolist())], "i int, a double, b double"), "p").orderBy("i").collect()]
    assert got == [int(2 * y[np.argsort(((x - p) ** 2).sum(1))[:5]].sum() > 5) for p in q]


def test_boosting_finds_the_best_stumps(spark):
    rows = spark.createDataFrame([(float(i), float(i % 3), int(3 <= i < 7)) for i in range(10)], "x double, z double, y int")
    model = ml.AdaBoost(["x", "z"], 20).fit(rows, "y")
    assert model.stumps[0][:2] in {("x", 2.5), ("x", 6.5)} and model.predict(rows, "p").where("p <> y").count() == 0
    flat = ml.AdaBoost(["x"], 5).fit(rows.withColumn("x", F.lit(1.0)), "y")
    assert flat.predict(rows, "p").where("p = 1").count() == 0


def test_cross_validation_and_scaler(spark, points):
    mean, deviation = ml.cross_validate(points, "dtree", ["x", "z"], "y", folds=3)
    assert mean > 0.9 and deviation >= 0
    one_class = points.withColumn("y", F.lit(0))
    assert ml.cross_validate(one_class, "knn", ["x", "z"], "y", "f1", folds=2) == (0.0, 0.0)  # f1 is the positive class's
    scaled = ml.train(points, "logreg", ["x", "z"], "y", scale=True)
    assert scaled.predict(points, "p").where("p = y").count() > 0.9 * points.count()


def test_embedder(spark, tmp_path):
    tokens = spark.createDataFrame([(t,) for t in ("alpha", "beta", "gamma", "delta")], "literal string")
    made = ml.Embedder().fit(tokens)
    row = made.transform(tokens).agg(F.avg("lit_vec").alias("m"), F.stddev_pop("lit_vec").alias("s")).first()
    assert row.m == pytest.approx(0, abs=1e-9) and row.s == pytest.approx(1)
    made.save(spark, f"{tmp_path}/e")
    assert vars(ml.Embedder.load(spark, f"{tmp_path}/e")) == vars(made)


@pytest.mark.parametrize("name", [n for n in plans.Q if n in plans.SQL])
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.sql(f"create view {t.split('.')[0]} as select * from '{SF}/{t}'")
    key = lambda rows: sorted(tuple("" if v is None or v != v else repr(round(float(v), 9)) if isinstance(v, (int, float)) else str(v) for v in r) for r in rows)
    want = c.sql(plans.SQL[name])
    cols = sorted(want.columns)
    got = plans.Q[name](spark, SF)
    assert sorted(got.columns) == cols
    assert key(got.select(*cols).collect()) == key(c.sql("select " + ", ".join(f'"{x}"' for x in cols) + f" from ({plans.SQL[name]})").fetchall())


def test_token_paths_all_counts_the_exploded_rows(spark):
    got = {(r.func_addr, r.string_addr): r.token_paths for r in plans.token_paths_all(spark, SF).collect()}
    known = labels.token_paths(plans.document_tokens(spark, SF), plans.paths(spark, SF), plans.strings(spark, SF))
    want = {(r.func_addr, r.string_addr): r["count"] for r in known.groupBy("func_addr", "string_addr").count().collect()}
    assert got == want


def test_token_paths_all_tokenizes_once(spark):
    """Strings are tokenized in one pass, and none in the plan of the result."""
    plan = plans.token_paths_all(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "tokenize_udf" not in plan and "mapinarrow" not in plan.lower()


def test_token_counts(spark, monkeypatch):
    rows = [(3, 30, "b a b"), (1, 10, "a c"), (2, 20, ""), (4, 40, None), (5, 50, "d. a")]
    strings = spark.createDataFrame(rows, "seq long, address long, literal string")
    for held in (200_000, 1):
        monkeypatch.setattr(labels, "HELD_TOKENS", held)
        found = labels.token_counts(strings)
        assert {r.string_addr: r.tokens for r in found.where("token is null").collect()} == {30: 3, 10: 2, 20: 0, 40: 0, 50: 2}
        first = first_wins(found.where("token is not null").select("token", "string_addr", "seq"), ["token"], ["seq"])
        assert {(r.token, r.string_addr) for r in first.collect()} == {(r.literal, r.string_addr) for r in labels.make_tokens(strings).collect()}


def test_embedding_takes_whole_texts(spark):
    got = {r.literal for r in plans.token_embedding(spark, SF).select("literal").collect()}
    assert got == {r.literal for r in labels.make_tokens(plans.strings(spark, SF)).select("literal").collect()}
