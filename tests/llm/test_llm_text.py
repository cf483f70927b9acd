"""Token counts, languages, toxicity, page text."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from conftest import DATA
from dayspell.llm import codeword_lang, page_text, piece_counts, subsequence_svm

EDGE = [None, "", " ", "  a  b ", "a\n\nb\tc", "x　y", "<s>hello</s> <0x0A>", "ﬁ①é é", "▁a ▁", "a ▁▁ b\x00c", "z" * 5000,
        "the cat\nsat", "the cat\nsat"]


def docs(spark, texts, **more):
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "no id"), (0, "same id again")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("n_tokens", "score", "n", "a", "b", "shard", "component"):  # names the operators use themselves
        frame = frame.selectExpr("*", f"'clash' as {name}")
    return frame


def test_token_counts_equal_the_library(spark):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    got = piece_counts.token_counts(docs(spark, EDGE), path, limit=1000).toPandas()
    assert len(got) == len(EDGE) + 2
    texts = [*EDGE, "no id", "same id again"]
    want = sorted((len((t or "").encode()), len(model.encode(t or ""))) for t in texts)
    assert sorted(zip(got["n_bytes"], got["n_tokens"], strict=True)) == want
    assert (got["over_limit"] == (got["n_tokens"] > 1000)).all()
    assert piece_counts.token_counts(docs(spark, EDGE).where("1 = 0"), path).count() == 0


def test_token_counts_of_real_texts():
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model, counts = sentencepiece.SentencePieceProcessor(model_file=path), piece_counts.PartCounts(path, most=50)
    rng, letters = np.random.default_rng(1), list("ab  ▁\n\té①😀<s>x0A1llñthe\x00中文　")
    texts = [t for (t,) in duckdb.sql(f"select text from '{DATA}/sf0.001/documents.parquet'").fetchall()]
    texts += ["".join(rng.choice(letters, rng.integers(0, 40))) for _ in range(500)]
    assert [counts.of(t) for t in texts] == [len(model.encode(t)) for t in texts]


def test_codebooks_can_correct_errors():
    for n in (3, 4, 5, 12):
        code = codeword_lang.codebook(n)
        gaps = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
        assert min(gaps) >= (3 if n > 3 else 2)
    assert codeword_lang.codebook(1).shape == (1, 1)


def test_languages_held_out(spark):
    documents = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    got = codeword_lang.identify(documents, codeword_lang.fit(documents, per_lang=40)).toPandas()
    truth = documents.select("doc_id", "lang").toPandas()
    both = got.merge(truth, on="doc_id")
    assert len(both) == len(truth) and both["score"].between(0, 1).all()
    test = both[both["held_out"]]
    assert (test["lang"] == test["lang_pred"]).mean() > 0.95


def test_languages_of_edge_cases(spark):
    model = codeword_lang.fit(docs(spark, ["der die das und", "the cat and dog"] * 20).selectExpr(
        "doc_id", "text", "case when text like 'der%' then 'de' when text like 'the%' then 'en' end lang"))
    got = codeword_lang.identify(docs(spark, [None, "", "123 !?", "der die das"]), model).toPandas().set_index("doc_id")
    assert (got.loc[[1, 2], "lang_pred"] == "und").all() and got.loc[3, "lang_pred"] == "de" and len(got) == 6
    nothing = codeword_lang.fit(docs(spark, ["a"]).selectExpr("doc_id", "text", "cast(null as string) lang"))
    assert set(codeword_lang.identify(docs(spark, ["abc"]), nothing).toPandas()["lang_pred"]) == {"und"}


def sample_of(texts, toxic):
    units = [sorted({u for w in subsequence_svm.words_of(t) for u in subsequence_svm.windows_of(w)}) for t in texts]
    return pd.DataFrame({"toxic": toxic, "key": range(len(texts)), "units": units})


@pytest.fixture(scope="module")
def svm():
    rng = np.random.default_rng(2)
    syllables = ["ba", "ko", "ri", "ten", "mul", "sa", "vo", "lin", "der", "pha"]
    word = lambda: "".join(rng.choice(syllables, rng.integers(1, 4)))
    texts, toxic = [], []
    for i in range(400):
        words = [word() for _ in range(30)]
        if i % 2:
            words[rng.integers(30)] = rng.choice(["grumpfkopf", "grumpfnase", "grumpfen", "zwixelnase", "zwixelkopf", "zwixelig"])
        texts.append(" ".join(words) + ".")
        toxic.append(i % 2)
    return subsequence_svm.learn(sample_of(texts, toxic), landmarks=32)


def test_gapped_insults_score_high(svm, spark):
    texts = ["Ba ko ri GRUMPFKOPF ten.", "ba grum.pf.ko.pf ko", "ba g r u m p f k o p f ko", "ba grumpfxkopf ko", "ba zwix3lnase",
             "ba ko ri ten mul", "derlin vosa kori", None, "", "1 2 3", "ba " * 5000 + "zwixelnase"]
    got = subsequence_svm.score(docs(spark, texts).select("doc_id", "text"), svm).toPandas()
    flags = dict(zip(got["doc_id"][: len(texts)], got["predicted"], strict=False))
    assert [flags[i] for i in range(11)] == [1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 1]
    assert got["score"].between(0, 1).all()


def test_kernel_is_symmetric_and_counts_runs(svm):
    k = svm.kernel
    a, b = "^grumpf", "^grumxpf"
    assert abs(k.value([a], k.table(b)[None, :])[0, 0] - k.value([b], k.table(a)[None, :])[0, 0]) < 1e-5
    assert k.value([a], k.table(b)[None, :])[0, 0] > 0.3 * k.value([a], k.table(a)[None, :])[0, 0]
    assert k.value(["ab"], k.table(a)[None, :])[0, 0] == 0


def test_toxicity_with_one_class_or_none(spark):
    documents = docs(spark, ["abc def", None, "xyz"])
    for rows in ([], [(0, 1)], [(0, None), (None, 1)], [(0, 0), (0, 0), (2, 0)]):
        labels = spark.createDataFrame(rows, "doc_id long, toxic int")
        got = subsequence_svm.toxicity(documents, labels).toPandas()
        assert len(got) == 5 and got["score"].between(0, 1).all() and got["score"].nunique() == 1


def test_toxicity_held_out(spark):
    documents, labels = (spark.read.parquet(f"{DATA}/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = subsequence_svm.toxicity(documents, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    english = got.merge(documents.where("lang = 'en'").select("doc_id").toPandas(), on="doc_id")
    test = english[english["held_out"]]
    assert (test["predicted"] == test["toxic"]).mean() > 0.95
    assert set(got["predicted"]) == {0, 1}


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="home"><header>Site</header>
<nav><ul><li><a href="/">Home</a></ul></nav><div class="cookie-notice">We use cookies</div>
<article><h1>Big &amp; small</h1><p>One  <b>bold</b>word<br>two<p>A < B &lt;c&gt; &#233;<div class="ad">Buy</div>
<ul><li>x<li>y</ul><aside>side</aside><form>f</form><script>var a="</p>"</script><!-- no <p>x</p> --></article>
<section id="comments"><article class="comment">Nice!</article></section><footer>f</footer></body></html>"""


def test_marked_articles(spark):
    rows = [(1, "http://h/1", PAGE), (2, "http://h/2", None), (3, None, ""), (None, "http://h/3", "<p>plain"), (1, "http://h/1", PAGE),
            (4, "http://h/4", "<main>a <span class='ad'>b <i>c</i></span> d</main>"), (5, "http://h/5", "<article>" + "w " * 50000)]
    got = page_text.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr(
        "*", "1 as text", "2 as host", "3 as blocks")).toPandas()
    texts = {None if pd.isna(i) else int(i): t for i, t in zip(got["page_id"], got["text"], strict=True)}
    assert texts[1] == "Big & small One boldword two A < B <c> é x y"
    assert texts[2] == texts[3] == "" and texts[None] == "plain" and texts[4] == "a d" and len(texts[5]) == 99999
    assert len(got) == 7 and (got["n_chars"] == got["text"].str.len()).all()


def test_repeated_runs_of_a_host_go(spark):
    common = "all rights reserved by the people of this very site since long ago"
    rows = [(i, f"http://h/{i}", f"<div>{common}</div><div>story number {i} has its own words {i}</div>") for i in range(4)]
    rows += [(9, "http://other/9", f"<div>{common}</div><div>elsewhere</div>"), (10, "http://h/0b", rows[0][2])]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in page_text.main_texts(frame).collect()}
    assert got[2] == "story number 2 has its own words 2"
    assert got[9] == f"{common} elsewhere"  # no other page of that host has it
    assert got[10] == got[0] == "story number 0 has its own words 0"  # equal pages count as one
    assert page_text.main_texts(frame.where("page_id < 0")).count() == 0


STORY = "<p>The story of the day has a first sentence.</p><p>And it has a second one.</p>"
TOLD = "The story of the day has a first sentence. And it has a second one."


@pytest.mark.parametrize("page", [
    f"<div class='layout has-sidebar'><article>{STORY}</article><div class=sidebar>Latest posts</div></div>",
    f"<div id='content-sidebar-wrap'><article>{STORY}</article><aside>Links</aside></div>",
    f"<article class='post has-comments'>{STORY}<div class=comments>I disagree</div></article>",
    f"<body><svg width=3 /><nav>Home</nav><article>{STORY}<svg viewBox='0 0 1 1'/></article><svg><text>icon</text></svg></body>",
    f"<div class='cookie-consent-open'><main>{STORY}</main></div>",
    f"<div class=sidebar><article>A teaser</article></div><article>{STORY}</article>",
    f"<article>{STORY}</article><div id=comments><article>A reader writes</article></div>",
    f"<article>{STORY}</article><div class='related'><article>Another story</article></div>"])
def test_articles_in_wrappers_with_chrome_names_stay(spark, page):
    frame = spark.createDataFrame([(1, "http://a.example/x", page)], "page_id long, url string, html string")
    assert [r["text"] for r in page_text.main_texts(frame).collect()] == [TOLD]


def test_boilerplate_inside_marked_articles_goes(spark):
    notice = "please read the rules of this very site before you write to us"
    teaser = "a long first sentence of the third story that others tease too"
    rows = [(i, f"http://h/{i}", f"<p>{notice}</p><div class=related>{teaser}</div><i>{i}</i><article><h1>Story {i}</h1><p>{notice}</p>own words {i}</article>")
            for i in (0, 1, 4)]
    rows += [(2, "http://h/2", f"<article><p>{teaser}</p>more</article>"), (3, "http://other/3", f"<article>{notice}</article>")]
    got = page_text.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert {r["page_id"]: r["text"] for r in got.collect()} == {
        0: "Story 0 own words 0", 1: "Story 1 own words 1", 4: "Story 4 own words 4", 2: f"{teaser} more", 3: notice}


def test_runs_that_most_articles_of_a_host_hold_go(spark):
    notice = "sign up here and get the news of this site by mail every single morning"
    own = [" ".join(f"word{k}of{i}" for k in range(40)) for i in range(5)]
    rows = [(i, f"http://h/{i}", f"<nav>Home</nav><article><p>{own[i]}</p><p>{notice}</p></article>") for i in range(4)]
    rows += [(4, "http://h/4", f"<article>{own[4]}</article>"), (5, "http://h/5", rows[4 - 1][2])]
    # three versions of a story are content, and so is what two articles share
    rows += [(10 + i, f"http://copies/{i}", f"<article><p>{own[0]}</p><p>version {i}</p></article>") for i in range(3)]
    rows += [(20 + i, f"http://two/{i}", f"<article><p>{own[i]}</p><p>{notice}</p></article>") for i in range(2)]
    # copies of a story do not hide a notice, nor make it one
    rows += [(30 + i, f"http://mixed/{i}", f"<article><p>{own[min(i, 3)]}</p><p>{notice}</p></article>" + f"<p>{i}</p>" * (i > 2)) for i in range(3)]
    rows += [(40 + i, f"http://mixed/c{i}", f"<article><p>{own[4]}</p><p>version {i}</p><p>{notice}</p></article>") for i in range(5)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = {r["page_id"]: r["text"] for r in page_text.main_texts(frame).collect()}
    assert got == {**{i: own[i] for i in range(5)}, 5: own[3], **{10 + i: f"{own[0]} version {i}" for i in range(3)},
                   **{20 + i: f"{own[i]} {notice}" for i in range(2)}, **{30 + i: own[i] for i in range(3)},
                   **{40 + i: f"{own[4]} version {i}" for i in range(5)}}
