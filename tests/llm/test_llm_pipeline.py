"""The pipeline's stages on rows with nulls, repeats and clashing names, against plain versions."""

import re

import corpus_pipeline
import pytest

from dayspell.llm import prefix_trie_join, subsequence_svm, template_leaks, weighted_mix
from dayspell.llm.queries import corpus_mix

A = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
NEAR_A = A + " " + " ".join(f"w{i}" for i in range(3))
B = " ".join(f"other{i}" for i in range(30))


def frame(spark, rows):
    return spark.createDataFrame([(*r, "en", "src1", len(r[1] or ""), 7.5, 1, 9) for r in rows],
                                 "doc_id long, text string, lang string, source string, n_chars int, score double, predicted int, component_id int")


def plain_components(rows, width, percent):
    """Component number per row by comparing all rows, and the links' transitive closure; equal ids are linked."""
    def shingles(text):
        words = re.findall("[^\x20\x09-\x0d]+", (text or "").lower())
        return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} or ({tuple(words)} if words else set())

    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            near = sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])
            same_id = rows[i][0] is not None and rows[i][0] == rows[j][0] and sets[i] and sets[j]
            if near or same_id:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(rows))], sets


ROWS = [(5, A), (5, A), (None, A), (3, NEAR_A), (None, B), (None, B), (None, B + " x"), (8, None), (8, None), (None, ""), (9, " \t "),
        (20, " ".join(f"u{i}" for i in range(40))), (None, " ".join(f"u{i}" for i in range(43))), (22, " ".join(f"u{i}" for i in range(46)))]


def test_rows_without_ids_link_and_bridge(spark):
    got = prefix_trie_join.similar_groups(frame(spark, ROWS), width=4, percent=80).collect()
    component, sets = plain_components(ROWS, 4, 80)
    want = []
    for i, (doc_id, _) in enumerate(ROWS):
        ids = [ROWS[j][0] for j in range(len(ROWS)) if component[j] == component[i] and ROWS[j][0] is not None]
        want.append((doc_id, len(sets[i]), min(ids) if sets[i] and ids else doc_id))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert (22, 43, 20) in want  # reached through the row without an id only


def test_one_row_of_each_group_stays(spark):
    got = [r["text"] for r in prefix_trie_join.without_copies(frame(spark, ROWS), width=4, percent=80).collect()]
    assert got.count(A) == 0 and got.count(NEAR_A) == 1 and sum(t in (B, B + " x") for t in got if t) == 1
    assert sum(not (t or "").strip() for t in got) == 4  # wordless rows link with nothing
    assert sum((t or "").startswith("u0 ") for t in got) == 1 and len(got) == 7


def test_near_copies_keep_one_of_each_component(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    component, sets = plain_components(rows, 5, 80)
    want = set()
    for i, (doc_id, _) in enumerate(rows):
        if not sets[i] or doc_id == min(rows[j][0] for j in range(len(rows)) if component[j] == component[i]):
            want.add(doc_id)
    got = prefix_trie_join.without_copies(docs, width=5, percent=80)
    assert got.columns == docs.columns and sorted(r["doc_id"] for r in got.collect()) == sorted(want)


def test_leaks_of_rows_without_ids(spark):
    item = "How many apples does Anna have if she buys 12 apples and eats 3 of them on Monday morning before school?"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(None, f"x {item} y"), (None, "an innocent text about nothing in particular at all"), (None, None), (4, item), (4, "same id, other text"), (6, B)]
    left = template_leaks.without_leaks(frame(spark, rows), bench).collect()
    assert sorted(str(r["text"])[:5] for r in left) == ["None", "an in", "other"]


def test_mixing_keeps_wordless_rows(spark):
    rows = [(i, A) for i in range(20)] + [(100, None), (None, ""), (101, " \n")]
    got = weighted_mix.mixed(frame(spark, rows), corpus_mix(share=0.5, epochs=1))
    texts = [r["text"] for r in got.collect()]
    assert got.columns == frame(spark, rows).columns and sum(t == A for t in texts) == 10 and len(texts) == 13


def test_clashing_columns_survive_the_toxicity_stage(spark):
    docs = frame(spark, ROWS)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = subsequence_svm.fit(docs, labels)
    left = subsequence_svm.without_toxic(docs, model)
    assert left.columns == docs.columns
    assert {(r["score"], r["predicted"], r["component_id"]) for r in left.collect()} == {(7.5, 1, 9)}


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_empty_tables_and_extra_columns(spark, stage):
    name, function = stage
    docs = frame(spark, ROWS)
    for rows in (docs, docs.where("1 = 0")):
        out = function(spark, rows, "/root/testdata/sf0.001")
        n = out.count()
        assert n <= rows.count() and (name == "sharding" or out.columns == rows.columns)
