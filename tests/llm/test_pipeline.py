"""The pipeline against a plain Python version on a small table with nulls, repeats, copies and clashing names."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from binlore.llm import encode, lines, quality
from binlore.llm.lines import stage_lines

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, hits string"
SPACED, ALNUM = r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text, pattern=SPACED, lower=True):
    return re.findall(pattern, (text or "").translate(LOWER) if lower else text or "")


def make_documents():
    """(rows, benchmark items)."""
    r = random.Random(7)
    word = lambda: "".join(r.choice("bcdfghklmnprst") + r.choice("aeiou") for _ in range(r.randint(2, 4)))
    prose = lambda n, per: "\n".join(" ".join(word() for _ in range(per)) for _ in range(n // per))
    texts = [prose(96, 12) for _ in range(30)] + [prose(120, 4) for _ in range(12)]
    for k in range(30, 36):  # near copies whose lines are too short for the line stage
        changed = texts[k].split(" ")
        changed[40] = word()
        texts.append(" ".join(changed))
    texts += [texts[3], texts[30]]  # exact copies
    texts += [f"{prose(60, 12)}\n{texts[5].split(chr(10))[0]}" for _ in range(3)]  # a shared line
    item = " ".join(word() for _ in range(14))
    texts += [f"{prose(60, 12)}\nbefore {item.upper()} behind", prose(40, 10), f"{word()} " * 80, None, ""]
    rows = [(k, t, "en", f"s{k % 3}") for k, t in enumerate(texts)]
    noisy = lambda: prose(60, 12) + " # # # # # # # #"
    rows += [(1000 + k, noisy() if k % 2 else prose(60, 12), "en", "noisy") for k in range(12)] + [(1100, noisy(), "en", "s0")]
    rows += [(None, prose(60, 12), "en", None), (None, prose(60, 12), "en", "s1"), rows[2], (7, prose(60, 12), "en", "s1")]
    return [(*x, len(x[1] or ""), "clash", None) for x in rows], [(1, item), (2, "nothing that is there at all, not one word of it"), (3, None)]


def brute_quality(rows):
    feats = []
    for x in rows:
        w = words_of(x[1], lower=False)
        wins = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        many = Counter(wins)
        rep = len({k + d for k, v in enumerate(wins) if many[v] > 1 for d in range(3)})
        own = [s for s in (x[1] or "").split("\n") if s.strip(" \t\n\x0b\f\r")]
        symbols = sum((x[1] or "").count(c) for c in "#*$%&|<>")
        feats.append((len(w) < 50, 100 * rep > 50 * len(w), 100 * symbols > 10 * len(w), 100 * (len(own) - len(set(own))) > 30 * len(own)))
    hosts = defaultdict(list)
    for x, f in zip(rows, feats):
        hosts[x[3]].append(f)
    n = {h: len(v) for h, v in hosts.items()}
    rates = {h: [] for h in hosts}
    for i in range(4):
        bad = {h: sum(f[i] for f in v) for h, v in hosts.items()}
        mean, var = sum(bad.values()) / len(rows), float(np.var([bad[h] / n[h] for h in hosts]))
        strength = min(max(mean * (1 - mean) / var - 1 if var > 0 else 10_000.0, 2.0), 10_000.0)
        for h in hosts:
            rates[h].append((bad[h] + mean * strength) / (n[h] + strength))
    good = lambda x, f: not f[0] and not f[1] and max(rates[x[3]]) <= 0.5 and not any(v and q > quality.SUSPECT_RATE for v, q in zip(f, rates[x[3]]))
    return [x for x, f in zip(rows, feats) if good(x, f)]


def components(items, linked):
    root = list(range(len(items)))
    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(items)):
        for j in range(i):
            if linked(items[i], items[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(items))]


def brute_lines(rows):
    order = lambda x, k: (x[0] is not None, x[0] or 0, zlib.crc32((x[1] or "").encode()) if x[0] in TWICE else 0, k)
    seen = {}
    for x in rows:
        for k, s in enumerate((x[1] or "").split("\n")):
            w = words_of(s)
            if len(w) >= lines.MIN_WORDS:
                key = " ".join(w)
                seen[key] = min(seen.get(key, order(x, k)), order(x, k))
    keys = sorted(seen, key=seen.get)
    sets = [{key[j : j + 5] for j in range(max(1, len(key) - 4))} for key in keys]
    root = components(sets, lambda a, b: 100 * len(a & b) >= 80 * len(a | b))
    place = {key: seen[keys[root[i]]] for i, key in enumerate(keys)}
    out = []
    for x in rows:
        left = [s for k, s in enumerate((x[1] or "").split("\n")) if place.get(" ".join(words_of(s)), order(x, k)) == order(x, k)]
        text = "\n".join(left) if x[1] is not None else None
        if text == x[1] or words_of(text):
            out.append((*x[:1], text, *x[2:4], None if text is None else len(text), *x[5:]))
    return out


#: Ids that stand on rows with different texts: which of their rows comes first is not fixed, so they share no lines in this table.
TWICE = {None, 7}


def brute_near(rows):
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := words_of(x[1])) else set() for x in rows]
    root = components(sets, lambda a, b: bool(a & b) and 100 * len(a & b) >= 80 * len(a | b))
    least = {}
    for x, r in zip(rows, root):
        if x[0] is not None:
            least[r] = min(least.get(r, x[0]), x[0])
    gone = {x[0] for x, r in zip(rows, root) if x[0] is not None and x[0] != least[r]}
    return [x for x in rows if x[0] not in gone or x[0] is None]


def brute_clean(rows, items):
    windows = [" ".join(w[k : k + 10]) for _, t in items if (w := words_of(t, ALNUM)) for k in range(max(1, len(w) - 9))]
    return [x for x in rows if not any(f" {v} " in f" {' '.join(words_of(x[1], ALNUM))} " for v in windows)]


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("documents"))
    rows, items = make_documents()
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, items


def test_pipeline_equals_plain_python(spark, small):
    folder, rows, items = small
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, sizes = docs.columns, [len(rows)]
    brute = [brute_quality, brute_lines, brute_near, lambda x: brute_clean(x, items)]
    for (name, stage), plain in zip(corpus_pipeline.STAGES, brute):
        rows = plain(rows)
        docs = spark.createDataFrame(stage(spark, docs, folder).toArrow(), SCHEMA)
        assert docs.columns == columns
        key = lambda x: tuple("" if v is None else str(v) for v in x)
        assert sorted(map(key, docs.collect())) == sorted(map(key, rows)), name
        sizes.append(len(rows))
    assert all(a > b for a, b in zip(sizes, sizes[1:]) if a != sizes[1]) and sizes[-1] > 40  # every filter has had work
    t = Tokenizer.from_file(encode.tokenizer_path("word_bpe_49k.json"))
    want = Counter()
    for x in rows:
        ids = np.array([*t.encode(x[1] or "", add_special_tokens=False).ids, 1], "<u4")
        want[(x[0], len(ids))] += len(ids)
    got = corpus_pipeline.run(spark, folder).toPandas()
    found = Counter()
    for p in got.itertuples():
        found[(None if np.isnan(p.doc_id) else int(p.doc_id), p.doc_tokens)] += p.length
    assert found == want
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 2048


def test_stages_take_empty_tables(spark, small):
    docs = spark.read.parquet(f"{small[0]}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, small[0]).count() == 0


def test_line_stage_keeps_what_is_left(spark):
    shared = "this licence line stands in both of the documents here"
    own = "forty or so words that occur nowhere else stay in the second one"
    docs = spark.createDataFrame([(1, shared, "en", "s", 0), (2, f"{shared}\n{own}", "en", "s", 0), (3, shared, "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id: r.text for r in stage_lines(spark, docs, "").collect()} == {1: shared, 2: own}
