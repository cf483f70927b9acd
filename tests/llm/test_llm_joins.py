"""Shards, mixes, leaks, near copies, aliases, search, and the pipeline."""

import math
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from conftest import DATA
from dayspell.llm import label_shards, prefix_trie_join, queries, template_leaks, url_aliases, wand_search, weighted_mix
from dayspell.llm.common import connected_components

TABLES = ("documents", "pages", "benchmark", "labels")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/sf0.001/{t}.parquet'")
    want = con.sql(queries.ORACLES[name])
    got = queries.QUERIES[name](spark, f"{DATA}/sf0.001")
    assert sorted(want.columns) == sorted(got.columns)
    key = lambda row: tuple((v is None, str(v)) for v in row)
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=key) == sorted(want.fetchall(), key=key)


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000, i) for i in range(2000, 2300)] + [(7, 7), (9000, 9000), (None, 1)]
    parent = {v: v for e in edges if None not in e for v in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    got = {r[0]: r[1] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: root(v) for v in parent}


# --- shards ---------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("texts", [
    [], ["a"], [None, "", "x"], ["same"] * 50, [f"t{i}" for i in range(100)],
    ["hot"] * 40 + [f"t{i % 30}" for i in range(61)], [f"g{i % 5}" for i in range(203)], [f"p{i // 2}" for i in range(160)]])
def test_shards_are_even_and_keep_equal_texts(spark, texts):
    rows = [(i, t, "clash") for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    got = label_shards.balanced_shards(frame, salts=16, buckets=16).collect()
    assert len(got) == len(texts)
    held = defaultdict(list)
    for r in got:
        held[r["shard"]].append(r["slot"])
        assert r["size"] == len((texts[r["doc_id"]] or "").encode()) + 1 and r["law"] == "rows" and r["grown_shard"] is None
    sizes = [len(held[s]) for s in range(8)]
    assert max(sizes) - min(sizes) <= 1 and set(held) <= set(range(8))
    assert all(sorted(v) == list(range(len(v))) for v in held.values())
    groups = defaultdict(Counter)
    for r in got:
        groups[texts[r["doc_id"]] or ""][r["shard"]] += 1
    quota = len(texts) // 8
    small = [c for c in groups.values() if 1 < sum(c.values()) <= quota]
    assert sum(len(c) > 1 for c in small) <= max(2, len(small) // 3)  # full shards' edges cut some


def test_shards_of_repeated_rows(spark):
    frame = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (None, None), (2, "b"), (2, "c")], "doc_id long, text string")
    got = label_shards.balanced_shards(frame, salts=8, buckets=4).toPandas()
    assert len(got) == 6 and got.groupby("shard").size().max() == 1


# --- mixing ---------------------------------------------------------------------------------------------------------

def water(caps, weights, given):
    """Reference: raise the level until the budget is dealt, in exact fractions."""
    from fractions import Fraction

    got, left, open_ = [Fraction(0)] * len(caps), Fraction(min(given, sum(caps))), [i for i, w in enumerate(weights) if w and caps[i]]
    while left > 0 and open_:
        total = sum(weights[i] for i in open_)
        step = min(min((caps[i] - got[i]) / Fraction(weights[i]) for i in open_), left / total)
        for i in open_:
            got[i] += step * weights[i]
        left -= step * total
        open_ = [i for i in open_ if got[i] < caps[i]]
    return got


def test_budgets_fill_siblings_first(spark):
    rng = np.random.default_rng(3)
    leaves = [(d, l, s, int(rng.integers(1, 500))) for d in "abc" for l in ("en", "de") for s in ("s1", "s2", "s3")]
    mix = weighted_mix.Mix(F.lit("a"), {"a": 5, "b": 2, "c": 1}, {"en": 3}, {"s3": 0}, budget=2500, epochs=2)
    frame = spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long")
    got = {(r[0], r[1], r[2]): r["budget"] for r in weighted_mix.leaf_budgets(frame, mix).collect()}
    caps = {(d, l, s): 2 * t * (s != "s3") for d, l, s, t in leaves}
    above = lambda *k: sum(v for key, v in caps.items() if key[: len(k)] == k)
    top = dict(zip("abc", water([above(d) for d in "abc"], [5, 2, 1], 2500), strict=True))
    for d in "abc":
        langs = dict(zip(("en", "de"), water([above(d, x) for x in ("en", "de")], [3, 1], top[d]), strict=True))
        for l in ("en", "de"):
            want = water([caps[d, l, s] for s in ("s1", "s2", "s3")], [1, 1, 0], langs[l])
            for s, w in zip(("s1", "s2", "s3"), want, strict=True):
                assert abs(got[d, l, s] - w) <= 3
    assert sum(got.values()) == min(2500, sum(caps.values()))
    assert all(got[k] <= caps[k] for k in got)


def test_mix_prefixes(spark):
    rows = [(i, "w " * (i % 7), "en" if i % 3 else None, "s1" if i % 4 else None, "clash") for i in range(80)] + [(3, None, None, None, "x"), (5, "w w", "en", "s1", "x"), (5, "w w", "en", "s1", "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, domain string")
    total = sum(len((r[1] or "").split()) for r in rows)
    for budget, epochs in ((50, 1), (total, 1), (total + 30, 2), (10 * total, 3)):
        mix = weighted_mix.Mix(F.lit("d"), budget=budget, epochs=epochs)
        got = weighted_mix.select_mix(frame, mix).select("m_doc.doc_id", "m_doc.domain", "tokens", "epoch", "taken").collect()
        assert sum(r["taken"] for r in got) == min(budget, epochs * total)
        assert all(0 < r["taken"] <= r["tokens"] and r["epoch"] < epochs for r in got)
        assert {r["domain"] for r in got} <= {"clash", "x"}
    assert weighted_mix.select_mix(frame.where("1 = 0"), mix).count() == 0


# --- leaks ----------------------------------------------------------------------------------------------------------

ITEM = ("If Alice walks 12 km in 3 hours and Bob walks 20 km in the same time, how many km more does Bob walk than Alice, "
        "and how far would Alice walk in 6 hours if she kept the pace she had on the first day of the trip?")


def leaked(spark, texts, items=(ITEM,)):
    documents = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, item_id int")
    benchmark = spark.createDataFrame([(i, t, 1) for i, t in enumerate(items)], "item_id long, text string, doc_id int")
    return sorted(tuple(r) for r in template_leaks.leaks(documents, benchmark).select("doc_id", "item_id").collect())


def test_templates_catch_new_parameters(spark):
    changed = ITEM.replace("Alice", "Carol").replace("Bob", "Dan").replace("12", "45").replace("20", "61").replace("km", "miles")
    mixed = re.sub(r"\b(Alice|Bob|\d+)\b", lambda m, n=iter(range(100, 200)): str(next(n)) if m[0].isdigit() else f"Na{chr(97 + next(n) % 26)}me", ITEM)
    texts = [f"Before. {ITEM} After.", f"Some words. {changed} More.", mixed, "Nothing at all to see in this text.", None, "", "x " * 30_000 + ITEM,
             ITEM[: len(ITEM) // 2], ITEM + " " + ITEM]
    assert leaked(spark, texts) == [(0, 0), (1, 0), (6, 0), (8, 0)]


def test_items_that_say_nothing(spark):
    assert leaked(spark, [ITEM, "a b c d"], (None, "", "a b c", "1 2 3 4 5 6 7")) == []
    assert leaked(spark, [], (ITEM,)) == [] and leaked(spark, [ITEM], ()) == []
    assert leaked(spark, [ITEM, ITEM], (ITEM, ITEM)) == [(0, 0), (0, 1), (1, 0), (1, 1)]


def test_leaks_in_other_case_edited_or_in_part(spark):
    words = ITEM.split()
    edited = " ".join(words[:20] + ["stroll"] + words[21:])
    texts = [f"so {ITEM.upper()} so", ITEM.lower(), edited, ITEM[: len(ITEM) * 3 // 4], ITEM[len(ITEM) // 4 :],
             " ".join([*words[:12], *["filler"] * 2_000, *words[12:24], *["filler"] * 2_000, *words[24:36]])]
    assert leaked(spark, texts) == [(0, 0), (1, 0), (2, 0), (3, 0), (4, 0)]
    short = "Straße und Haus stehen am Rande der Stadt, wo Anna im Mai wohnt."  # 13 tokens
    texts = [short.upper(), short.lower(), short.replace("am", "an"), "Die Stadt, wo Anna wohnt."]
    assert leaked(spark, texts, (short,)) == [(0, 0), (1, 0), (2, 0)]
    assert leaked(spark, ["so anna bert carla dora emil so"], ("Anna Bert Carla Dora Emil",)) == [(0, 0)]  # no template tells of it


# --- near copies ----------------------------------------------------------------------------------------------------

def shingle_set(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words)} - {()} if len(words) < width else {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def brute_components(rows, width, percent):
    sets = [(d, shingle_set(t, width)) for d, t in rows]
    parent = {d: d for d, _ in sets if d is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if s and t and None not in (a, b) and 100 * len(s & t) >= percent * len(s | t):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return [(d, len(s), root(d) if d is not None else None) for d, s in sets]


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80)])
def test_near_copies_like_brute_force(spark, width, percent):
    rng = np.random.default_rng(width)
    words = [f"w{i}" for i in range(300)]
    passage = " ".join(rng.choice(words, 60))
    rows, k = [], 0
    for g in range(12):
        base = list(rng.choice(words, rng.integers(20, 120)))
        for _ in range(rng.integers(1, 9)):
            copy = list(base)
            for _ in range(rng.integers(0, 4)):
                copy[rng.integers(len(copy))] = str(rng.choice(words))
            rows.append((k, " ".join(copy)))
            k += 1
    rows += [(k + i, f"{passage} {' '.join(rng.choice(words, 30))}") for i in range(15)]
    rows += [(200, None), (201, ""), (202, " \n\t"), (203, "one"), (204, "ONE"), (205, "one two three"), (206, "One two\nthree"), (207, "a b c d e f g h"),
             (208, "a b c d e f g h i"), (209, "é É"), (0, rows[3][1]), (1, rows[1][1])]
    frame = spark.createDataFrame([(d, t, "clash", 1) for d, t in rows], "doc_id long, text string, n string, rep int")
    got = prefix_trie_join.similar_groups(frame, width, percent, block=4)
    assert sorted(tuple(r) for r in got.collect()) == sorted(brute_components(rows, width, percent))


def test_near_copies_of_nothing(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert prefix_trie_join.similar_groups(frame).count() == 0
    frame = spark.createDataFrame([(None, "a b c d e"), (7, "a b c d e"), (None, None)], "doc_id long, text string")
    got = sorted(((r[0] or -1, r[1], r[2] or -1) for r in prefix_trie_join.similar_groups(frame).collect()))
    assert got == [(-1, 0, -1), (-1, 2, 7), (7, 2, 7)]
    assert prefix_trie_join.without_copies(frame).count() == 3


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (10, 500, 2100, 4200, 9000)]
    sets += [s[rng.random(len(s)) > 0.1] for s in sets]
    marks = [prefix_trie_join.sketch(s) for s in sets]
    a, b = (np.array(x) for x in zip(*[(i, j) for i in range(10) for j in range(10)], strict=True))
    gaps = prefix_trie_join.sketch_gaps(marks, a, b)
    assert all(g <= len(np.setxor1d(sets[i], sets[j])) for g, i, j in zip(gaps, a, b, strict=True))
    assert gaps[3 * 10 + 8] > 0 and gaps[44] == 0 and gaps[3 * 10 + 4] > 0.2 * len(sets[3])


def test_trie_matches_like_brute_force():
    rng = np.random.default_rng(4)
    for percent in (60, 80, 85, 100):
        base = np.unique(rng.integers(0, 4000, 150).astype(np.uint64))
        stored = []
        for _ in range(60):
            drop = rng.random(len(base)) > rng.choice([0, 0.05, 0.1, 0.3])
            stored.append(np.unique(np.r_[base[drop], rng.integers(0, 4000, rng.integers(0, 25)).astype(np.uint64)]))
        want = {i for i, s in enumerate(stored) if 100 * len(np.intersect1d(base, s)) >= percent * len(np.union1d(base, s))}
        assert set(prefix_trie_join.trie_matches(base, stored, percent)) == want


# --- aliases --------------------------------------------------------------------------------------------------------

def test_aliases_share_decisions(spark):
    link = lambda to: f'<head><link rel="canonical" href="{to}"></head>'
    move = lambda to: f'<meta http-equiv="refresh" content="0; url={to}">'
    rows = [(1, "http://a.org/x", link("https://bad.net/y")), (2, "http://b.org/q?i=1#top", move("http://a.org/x")), (3, "https://c.org/z", None),
            (4, "http://d.org/fr/1", link("http://bad.net/k")), (5, "http://e.org/2", link("http://d.org/fr/1")), (6, None, link("http://bad.net/")), (7, "no scheme", ""),
            (8, "http://F.ORG/dir/a", link("b")), (9, "http://f.org/dir/b", link("//bad.net/m")), (10, "http://bad.net", ""), (11, "http://x.example.net/en/1", link("http://bad.net/k9")),
            (12, "http://g.org/a#one", link("#two")), (1, "http://a.org/x", link("https://bad.net/y"))]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as node", "2 as component", "3 as a")
    extra = spark.createDataFrame([("http://c.org/z", "http://b.org/q?i=1"), (None, "http://b.org/"), ("http://b.org/", None)], "from_url string, to_url string")
    got = url_aliases.judge(frame, queries.RULES, extra).collect()
    verdicts = {r["page_id"]: (r["verdict"], r["decided_by"], r["rule"]) for r in got}
    assert len(got) == len(rows)
    for page in (1, 2, 3, 8, 9):
        assert verdicts[page] == ("block", "alias", None), page
    assert verdicts[4] == ("allow", "rule", "org/fr/") and verdicts[5] == ("allow", "default", None)
    assert verdicts[6] == verdicts[7] == verdicts[12] == ("allow", "default", None)
    assert verdicts[10] == ("allow", "default", None)  # an empty path begins with no rule's path
    assert verdicts[11] == ("allow", "rule", "example.net/en/")
    assert url_aliases.judge(frame.where("1 = 0"), queries.RULES).count() == 0


# --- search ---------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("shard_terms", [150, 10**6])
def test_search_like_brute_force(spark, shard_terms):
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(400)]
    weights = 1 / np.arange(1, 401)
    rows = [(i, " ".join(rng.choice(words, rng.integers(1, 60), p=weights / weights.sum())).title()) for i in range(150)]
    rows += [(150, rows[3][1]), (151, None), (152, "!?"), (None, "w1 w2"), (150, rows[4][1]), (153, "W1, w1 ü")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as shard", "2 as score", "3 as terms")
    bags = [(d, Counter(re.findall(r"[^\s]+", re.sub(r"[^a-z0-9\x80-\U0010ffff]", " ", (t or "").lower())))) for d, t in rows if d is not None]
    bags = [(d, b) for d, b in bags if b]
    df, n = Counter(t for _, b in bags for t in b), len(bags)
    mean = sum(sum(b.values()) for _, b in bags) / n
    want = {}
    asked = defaultdict(set)
    for d, b in bags:
        if d % 50 == 0:
            asked[d] |= set(b)
    for q, terms in asked.items():
        scores = [(round(sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * b[t] * 2.2 / (b[t] + 1.2 * (0.25 + 0.75 * sum(b.values()) / mean)) for t in terms if t in b), 8), d) for d, b in bags]
        want[q] = sorted(((s, d) for s, d in scores if s > 0), key=lambda x: (-x[0], x[1]))[:10]
    got = defaultdict(list)
    for r in wand_search.top_matches(frame, frame.where("doc_id % 50 = 0"), shard_terms=shard_terms).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["score"], r["doc_id"]))
    assert set(got) == set(want)
    for q, rows_ in want.items():
        assert [d for _, d in got[q]] == [d for _, d in rows_]
        assert np.allclose([s for s, _ in got[q]], [s for s, _ in rows_], atol=1e-6)


def test_search_sends_no_query_through_a_shuffle_per_shard(spark, monkeypatch):
    plans = []

    def seen(df, **options):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return staged(df, **options)

    staged = wand_search.staged
    monkeypatch.setattr(wand_search, "staged", seen)
    frame = spark.createDataFrame([(i, f"w{i % 7} w{i % 11} common") for i in range(200)], "doc_id long, text string")
    assert wand_search.top_matches(frame, frame, shard_terms=60).groupBy("query_id").count().where("count = 10").count() == 200
    assert "CartesianProduct" in plans[-1] and "Exchange" not in plans[-1]


def test_search_in_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert wand_search.top_matches(empty, empty).count() == 0


# --- pipeline -------------------------------------------------------------------------------------------------------

def test_pipeline_stage_by_stage(spark):
    sf = f"{DATA}/sf0.001"
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    docs, seen = documents, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.count()
        docs = stage(spark, docs, sf)
        seen[name] = (before, docs.cache().count())
        if name != "sharding":
            assert docs.columns == documents.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == list(seen)
    assert all(a > b for n, (a, b) in seen.items() if n != "sharding"), seen
    assert seen["sharding"][0] == seen["sharding"][1]
    final = docs.toPandas()
    assert final.groupby("shard").size().agg(["min", "max"]).diff().iloc[-1] <= 1
    assert len(set(final["doc_id"])) == len(final)


def test_only_postings_with_a_fitting_partner_stay(spark):
    shared = spark.createDataFrame([(1, 1, 100), (1, 2, 110), (1, 3, 200), (2, 1, 100), (2, 4, 100), (3, 5, 100), (3, 1, 105), (3, 4, 140)],
                                   "ngram long, rep long, n long")
    components = spark.createDataFrame([(1, 1), (4, 1)], "node long, component long")
    got = {(r["ngram"], r["rep"]) for r in prefix_trie_join._unsettled(shared, components, 85).collect()}
    assert got == {(1, 1), (1, 2), (3, 5), (3, 1)}  # 3 is too long, 1 and 4 are one component, 4 fits 1 only


def test_batches_in_pieces():
    import pandas as pd

    from dayspell.llm.shingles import pieces
    frames = [pd.DataFrame({"a": range(n)}) for n in (2500, 0, 3)]
    parts = list(pieces(iter(frames)))
    assert [len(p) for p in parts] == [1000, 1000, 500, 3]
    assert pd.concat(parts).equals(pd.concat(frames))


def test_search_asks_a_shard_for_each_term_of_a_batch_once(monkeypatch):
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{t}" for t in rng.integers(0, 60, 30)) for _ in range(400)]
    shards = pd.concat(wand_search._shards(3000)(iter([pd.DataFrame({"doc_id": range(400), "text": texts})])), ignore_index=True)
    terms = [next(iter(wand_search.term_rows([t])))[0] for t in texts]
    asked = pd.DataFrame({"query_id": range(400), "terms": terms, "weights": [np.ones(len(t)) for t in terms]})
    [queries] = wand_search._query_rows(iter([asked]))
    pairs, looked_up, places = shards.merge(queries, how="cross"), [], wand_search.Shard.places
    monkeypatch.setattr(wand_search.Shard, "places", lambda self, t: looked_up.append(len(t)) or places(self, t))
    batches = [pa.RecordBatch.from_pandas(pairs.iloc[i : i + 1], preserve_index=False) for i in range(len(pairs))]
    [found] = wand_search._search(30.0, 10)(iter(batches))
    assert len(shards) > 2 and found.num_rows == 4000
    assert looked_up == [60] * len(shards)  # not once per query that holds it
