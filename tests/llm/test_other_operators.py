from __future__ import annotations

import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import chat, html_text, pieces, queries, token_counts, toxicity
from tests.llm import fixtures as fx

TOKENIZERS = Path(queries.TOKENIZERS)
needs_files = pytest.mark.skipif(not TOKENIZERS.is_dir(), reason="the public tokenizer files are not here")
PARTS = ["a", "b", "the", " ", "  ", "\n", "\r", "é", "漢", "字", "\t", "1", "23", ";", "ing", "tion", "𝄞", "x" * 9]


def texts(n=600, seed=2):
    draw = random.Random(seed)
    return ["".join(draw.choice(PARTS) for _ in range(draw.randint(0, 25))) for _ in range(n)] + ["", " ", "  ", None, "ab" * 400, "hello world " * 50, "é" * 300]


@needs_files
def test_bpe_pieces_equal_the_library():
    import sentencepiece

    path = str(TOKENIZERS / "piece_bpe_32k.model")
    library, encoder, every = sentencepiece.SentencePieceProcessor(model_file=path), pieces.Encoder(pieces.load(path)), texts()
    ids, bounds = encoder.encode(every)
    back = encoder.decode(ids, bounds)
    for i, t in enumerate(every):
        own = ids[bounds[i] : bounds[i + 1]].tolist()
        assert own == library.encode(t or "")
        assert back[i] == (t or "")
    again, _ = encoder.encode(every)  # from memory
    assert again.tolist() == ids.tolist()


@needs_files
def test_unigram_viterbi_equals_the_library(tmp_path):
    """The same pieces with unigram scores, as a unigram model."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    model.ParseFromString((TOKENIZERS / "piece_bpe_32k.model").read_bytes())
    model.trainer_spec.model_type = pieces.UNIGRAM
    kept = [p for p in model.pieces if p.score > -1e8]
    for k, p in enumerate(kept):
        if p.type == pieces.NORMAL:
            p.score = -float(int(np.log(2 + k) * 64)) / 64
    del model.pieces[:]
    model.pieces.extend(kept)
    path = tmp_path / "unigram.model"
    path.write_bytes(model.SerializeToString())
    library, encoder, every = sentencepiece.SentencePieceProcessor(model_file=str(path)), pieces.Encoder(pieces.load(str(path))), [*texts(seed=3), "漢字the" * 300, "abc" * 3000]
    ids, bounds = encoder.encode(every)
    for i, t in enumerate(every):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == library.encode(t or "")


@needs_files
def test_both_models_equal_the_library_on_every_document(spark, small, tmp_path):
    """The registered query's ids, merges and Viterbi, of every text of the smallest table."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as proto

    path = TOKENIZERS / "piece_bpe_32k.model"
    vocabulary = pieces.load(str(path))
    model = proto.ModelProto()
    model.ParseFromString(path.read_bytes())
    model.trainer_spec.model_type = pieces.UNIGRAM
    for p, score in zip(model.pieces, vocabulary.as_unigram().scores, strict=True):
        p.score = score
    (tmp_path / "unigram.model").write_bytes(model.SerializeToString())
    merges, best = sentencepiece.SentencePieceProcessor(model_file=str(path)), sentencepiece.SentencePieceProcessor(model_file=str(tmp_path / "unigram.model"))
    docs = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    encoder = pieces.Encoder(vocabulary, vocabulary.as_unigram())
    got = {r["doc_id"]: r for r in queries.op3_sentencepiece(spark, small).collect()}
    (a, at), (b, bt) = encoder.encode_all([t for _, t in docs])
    for i, (d, t) in enumerate(docs):
        one, two = merges.encode(t), best.encode(t)
        assert a[at[i] : at[i + 1]].tolist() == one and b[bt[i] : bt[i + 1]].tolist() == two
        assert (got[d]["n_tokens"], got[d]["unigram_n_tokens"], got[d]["differs"]) == (len(one), len(two), one != two)
        assert got[d]["restored"] and got[d]["unigram_restored"]


@needs_files
def test_encode_and_decode_frames(spark):
    vocabulary = pieces.load(str(TOKENIZERS / "piece_bpe_32k.model"))
    df = spark.createDataFrame([(1, "some text\nhere"), (2, None), (3, ""), (3, "")], "doc_id long, text string").withColumn("ids", F.lit("old")).withColumn("row", F.lit(1))
    coded = pieces.encode(df, vocabulary, decoded_col="decoded")
    assert coded.columns == ["doc_id", "text", "row", "ids", "decoded"]
    back = pieces.decode(coded, vocabulary, text_col="again").collect()
    assert sorted((r["doc_id"], r["decoded"], r["again"], len(r["ids"]) > 0) for r in back) == [(1, "some text\nhere", "some text\nhere", True), (2, "", "", False), (3, "", "", False), (3, "", "", False)]
    assert pieces.encode(df.limit(0), vocabulary).collect() == []


INSULTS = ["scum", "loser", "mistkerl"]


def labelled(n=900, seed=4):
    draw, rows = random.Random(seed), []
    for i in range(n):
        w = [f"word{draw.randrange(400)}" for _ in range(draw.randint(5, 60))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(2):
                w.insert(draw.randrange(len(w)), draw.choice(INSULTS) + draw.choice(["", ",", "!"]))
        rows.append((i, " ".join(w), "de" if i % 3 else "en", int(toxic)))
    return rows


def test_toxicity_on_held_out_rows(spark):
    rows = labelled()
    docs = spark.createDataFrame([r[:3] for r in rows] + [(-1, None, None), (-2, "", "en"), (-3, "q " * 30000 + "scum loser", "xx")], "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows] + [(0, 1), (None, 1), (5, None), (99999, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    out = toxicity.toxicity(docs, model, out_col="score")
    got = {r["doc_id"]: r for r in out.withColumn("part", toxicity.part("doc_id")).collect()}
    assert len(got) == len(rows) + 3
    held = [(got[r[0]], r[3]) for r in rows if got[r[0]]["part"] == 2]
    assert sum((g["score"] >= 0.3) == y for g, y in held) / len(held) > 0.97
    assert sum(g["rejected"] == y for g, y in held) / len(held) > 0.97
    assert all(0 <= g["score"] <= 1 for g in got.values())
    assert got[-1]["score"] == got[-2]["score"] < 0.3 and got[-3]["score"] >= 0.3
    assert set(model.thresholds) <= {"de", "en"}


def test_toxicity_learns_nothing_from_held_out_rows(spark):
    rows = labelled(300)
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, toxic int")
    turned = labels.withColumn("toxic", F.when(toxicity.part("doc_id") == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.train(docs, labels, steps=20), toxicity.train(docs, turned, steps=20)
    assert (a.table == b.table).all() and a.thresholds == b.thresholds and a.bias == b.bias


def test_toxicity_passes_over_texts_that_do_not_fit(spark):
    rows = labelled(300)
    docs = spark.createDataFrame([r[:3] for r in rows] + [(i, "long " * 3000, "en") for i in range(1000, 1040)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows] + [(i, i % 2) for i in range(1000, 1040)], "doc_id long, toxic int")
    without = toxicity.train(docs, labels.where("doc_id < 1000"), steps=20, max_bytes=100_000)
    assert without.weights.any()
    some = toxicity.train(docs, labels, steps=20, max_bytes=14_000)  # less than one of the long texts
    assert some.weights.any()
    none = toxicity.train(docs, labels, steps=20, max_bytes=0)
    assert len({r["toxicity"] for r in toxicity.toxicity(docs, none).collect()}) == 1
    sizes = [[{"id": 1, "y": 0, "size": 90}, {"id": 2, "y": 0, "size": 20}], [{"id": 3, "y": 1, "size": 200}, {"id": 4, "y": 1, "size": 10}, {"id": 5, "y": 1, "size": None}]]
    assert toxicity._within(sizes, 100) == [(1, 0), (4, 1), (5, 1)]


def test_toxicity_thresholds_of_all_labelled_rows(spark):
    """A language whose labelled rows are hardly in the sample has its own threshold; held out rows count for nothing."""
    rows = [(i, text, "fr" if i % 16 < 2 else lang, y) for i, text, lang, y in labelled(900)]
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, steps=60, rows_per_class=30)
    assert set(model.thresholds) == {"de", "en", "fr"}
    fitted = spark.createDataFrame([(1,)], "id long")
    marks = labels.selectExpr("doc_id as id", "toxic as y").where(toxicity.part("id") != 2)
    found = toxicity._score_counts(model, docs.withColumnRenamed("doc_id", "id"), marks, fitted)
    known = marks.where("id <> 1").count()
    assert sum(n for name, _, _, n in found if name == "") == known == sum(n for name, _, _, n in found if name)
    score = {r["doc_id"]: r["toxicity"] for r in toxicity.toxicity(docs, model).collect()}
    assert all(0 <= at < toxicity.BINS for _, _, at, _ in found)
    want = sum(score[r["id"]] >= 0.5 for r in marks.where("id <> 1").collect())
    assert sum(n for name, _, at, n in found if name and at >= toxicity.BINS / 2) == want


def test_toxicity_with_one_label_or_none(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    for labels in ([], [(1, 0), (2, 0)]):
        model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        scores = {r["toxicity"] for r in toxicity.toxicity(docs, model).collect()}
        assert len(scores) == 1 and 0 < scores.pop() <= 0.5
    assert toxicity.toxicity(docs.limit(0), model).collect() == []


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><div class="cookie-notice">We use cookies</div><ul class=menu><li><a href=1>Home<li><a href=2>About</ul>
<div id=content><article><header><h1>Title &amp; more</h1></header><p>First   para<br>line&nbsp;two &#8212; it goes on for quite a while so that it is long.<p>Short.
<form><input><label>Mail</label></form><aside>side</aside><ul><li>one<li>two</ul><div class="ad-box"><p>Buy now</p></div><script>x</script><p hidden>gone</p></article>
<section id="comments"><h2>Comments</h2><article class=comment><p>great post, I have to say that it is the greatest that I ever read!!!</article></section></div><footer>bye &copy;</footer>"""


def test_main_text():
    assert html_text.main_text(PAGE) == "Title & more\n\nFirst para line two — it goes on for quite a while so that it is long.\n\nShort.\n\none\n\ntwo"
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<div>  </div>") == ""
    assert html_text.main_text("plain <b>text") == "plain text"
    assert html_text.main_text("<![if x]>a<p>b <!-- c --> d</p><") == "a\n\nb d\n\n<"


def test_main_text_without_article_elements():
    p = "Long text here that goes on and on and on, with words for the reader to enjoy, at length, really."
    page = f'<body><div><a href=a>Alpha</a> <a href=b>Beta</a> <a href=c>Gamma</a></div><div><div><p>{p}</p><p>Ok.</p><p>{p}</p></div></div><div><a href=x>imprint</a></div></body>'
    assert html_text.main_text(page) == f"{p}\n\nOk.\n\n{p}"


def test_main_text_of_other_layouts():
    p = "A paragraph with a good many words, so that it is plainly the text that readers came for, and nothing else."
    head = '<div class="site-header"><a href=/>Home</a></div><div id="leftSidebar"><p>' + p + "</p></div>"
    for wrap in ('<main class="col"><div class="post-header"><h1>Head</h1></div>{0}</main>', '<div class="entry elementor-widget"><h1>Head</h1>{0}</div>', "<table><tr><td><a href=1>one</a><td><h1>Head</h1>{0}</table>"):
        page = f'<html><body>{head}{wrap.format(f"<p>{p}<p>Yes.<p>{p}")}<div class="shareBar">Share</div><div class="hidden">{p}</div><div role="contentinfo">{p}</div></body></html>'
        assert html_text.main_text(page) == f"Head\n\n{p}\n\nYes.\n\n{p}"


def test_main_text_inside_wrappers_with_names_of_parts():
    """A name such as with-sidebar on an element around the article frames nothing; on a part it still does."""
    p = "A paragraph with a good many words, so that it is plainly the text that readers came for, and nothing else."
    story, side = f"<h1>Head</h1><p>{p}<p>Yes.<p>{p}", f'<div class="sidebar"><p>{p}</p></div>'
    comments = f'<div id="comments"><article class="comment"><p>{p}</p></article>' + f"<p>{p}</p>" * 9 + "</div>"
    related = f'<section class="related"><article><p>{p}</article></section>'
    for name in ("content-sidebar-wrap", "with-sidebar", "no-sidebar", "search-page", "comments-open"):
        for inner in ("<article>{0}</article>", "<main>{0}</main>", "<main><article>{0}</article></main>", "<div>{0}</div>"):
            for rest in ("", related if "article" in inner else "", comments if "<div>" not in inner else ""):
                if name == "comments-open" and "<div>" in inner and rest:
                    continue
                page = f'<body><div class="{name}">{inner.format(story)}{side if name != "no-sidebar" else ""}</div>{rest}<div>Copyright</div></body>'
                assert html_text.main_text(page) == f"Head\n\n{p}\n\nYes.\n\n{p}", (name, inner, rest)
    assert html_text.main_text(f"<body><article>{story}</article>{side * 9}{comments}</body>") == f"Head\n\n{p}\n\nYes.\n\n{p}"


def test_main_text_next_to_article_teasers():
    """Articles are the region only if they hold most of the dense text; smaller siblings and lists of links stay."""
    p = "A paragraph with a good many words, so that it is plainly the text that readers came for, and nothing else."
    story, want = f"<h1>Head</h1><p>{p}<p>Yes.<p>{p}" + f"<p>{p}" * 8, f"Head\n\n{p}\n\nYes." + f"\n\n{p}" * 9
    for teaser in ("<article class='card'><a href=x>More of the same</a></article>", "<article>Short teaser</article>"):
        for inner in ("<main>{0}</main>", "<div>{0}</div>"):
            for page in (f"{inner.format(story)}<div>{teaser}</div>", f"<div>{teaser}</div>{inner.format(story)}"):
                assert html_text.main_text(f"<body>{page}</body>") == want, (teaser, inner)
    small = f"<article><h2>Second</h2><p>{p}</article>"
    assert html_text.main_text(f"<body><div><article>{story}</article>{small}</div></body>") == f"{want}\n\nSecond\n\n{p}"
    assert html_text.main_text(f'<body><div><article>{story}</article><article class="related">{p}</article></div></body>') == want
    links = "<ul><li><a href=1>A first source</a><li><a href=2>A second source</a></ul>"
    nav = "<div><a href=a>Alpha</a> <a href=b>Beta</a></div>"
    assert html_text.main_text(f"<body>{nav}<div>{story}{links}</div>{nav}</body>") == f"{want}\n\nA first source\n\nA second source"
    assert html_text.main_text(f"<body>{nav}{story}<p><a href=1>A first source</a><p>{p}<p>{p}<p>{p}{nav}</body>") == f"{want}\n\nA first source" + f"\n\n{p}" * 3


LONG = "A paragraph with a good many words, so that it is plainly the text that readers came for, and nothing else."


def test_main_text_drops_no_content():
    """Headings, sections, link lists, formulas and short articles that a list of words could take for something else."""
    inside = [
        ('<h2 id="results-and-discussion">Results and Discussion</h2>', ["Results and Discussion"]),
        ('<h2 id="how-to-share-a-menu">How to share a menu</h2>', ["How to share a menu"]),
        (f'<section id="discussion"><h2>Discussion</h2><p>{LONG}</p></section>', ["Discussion", LONG]),
        (f'<section id="our-menu"><h2>Our menu</h2><p>{LONG}</p></section>', ["Our menu", LONG]),
        (f'<div class="post-header"><p>{LONG}</p></div><p class="notice">Note.</p>', [LONG, "Note."]),
        (f'<div class="recommended-reading-of-the-week"><p>{LONG}</p></div>', [LONG]),
        ('<p>So <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation encoding="t">x=2</annotation></math> holds.</p>', ["So x=2 holds."]),
        ('<p><a href=1>A source of links</a> and <a href=2>another of these</a></p>', ["A source of links and another of these"]),
        ("<ul><li><a href=1>One</a><li><a href=2>Two</a></ul>", ["One", "Two"]),
    ]
    outside = '<nav><a href=1>Home</a></nav><div class="ad-slot"><p>Buy this now, it is the best.</p></div><div id="comments"><h2>Comments</h2><div class="comment"><p>First!</p></div></div>'
    for wrap in ("<article><h1>Head</h1><p>{p}</p>{x}<p>{p}</p></article>", "<main><h1>Head</h1><p>{p}</p>{x}<p>{p}</p></main>", '<div id="wrap"><h1>Head</h1><p>{p}</p>{x}<p>{p}</p></div>'):
        for markup, texts_of in inside:
            page = f"<body>{outside}{wrap.format(p=LONG, x=markup)}<footer>End</footer></body>"
            assert html_text.main_text(page).split("\n\n") == ["Head", LONG, *texts_of, LONG], (wrap, markup)
    two = f"<body><article><h1>Head</h1>{f'<p>{LONG}</p>' * 9}</article><article><h2>Second</h2><p>Short one, but it is a story.</p></article></body>"
    assert html_text.main_text(two).split("\n\n") == ["Head", *[LONG] * 9, "Second", "Short one, but it is a story."]
    assert html_text.main_text(f"<body><div><p><a href=1>Only a link, but a paragraph of its own</a></p><p>{LONG}</p><p>{LONG}</p></div></body>").startswith("Only a link")
    assert html_text.main_text(f"<form><div id=top>Menu</div><article><h1>Head</h1><p>{LONG}</p></article><input></form>") == f"Head\n\n{LONG}"


def test_main_text_of_generated_pages():
    """Pages put together at random from known parts of the article and known other parts."""
    draw, right, found, wanted = random.Random(12), 0, 0, 0
    for _ in range(300):
        body = [("<h1>Title of it</h1>", "Title of it")]
        for i in range(draw.randint(2, 12)):
            words_of = " ".join(draw.choice(["word", "longer", "of", "text", "reading"]) for _ in range(draw.choice([1, 4, 30, 80])))
            kind = draw.choice(["<p>{0}</p>", "<p>{0}", "<h2 id=share-{1}>{0}</h2>", "<blockquote><p>{0}</p></blockquote>", "<ul><li>{0}</ul>", "<div class=figure-wide><p>{0}</p></div>", "<p><b>{0}<br></p>", "<pre>{0}</pre>"])
            body.append((kind.format(words_of, i), words_of))
        noise = ["<nav><ul><li><a href=1>Home</a><li><a href=2>News of today</a></ul></nav>", "<header><h2>Site</h2></header>", "<nav>Menu</nav>", "<aside><p>" + "side text " * 20 + "</aside>", "<div class=cookie-banner><p>We use cookies</p></div>", "<div id=sidebar><p>" + "about us " * 9 + "</p></div>", "<form><label>Mail</label><input></form>", "<div class='ad ad-top'>Buy</div>", "<section class=comments><p>" + "great post " * 9 + "</p></section>", "<ul class=share-buttons><li>Share</ul>", "<script>var x = '<p>no</p>'</script>"]
        wrap = draw.choice(["<article>{0}</article>", "<main><article class='post has-sidebar'>{0}</article></main>", "<main>{0}</main>", "<div class=content><div class=text>{0}</div></div>", "<div class=page-with-sidebar><article>{0}</article></div>"])
        inner = "".join(m + (draw.choice(noise[2:]) if draw.random() < 0.2 else "") for m, _ in body)
        page = "<!DOCTYPE html><html><head><title>T</title></head><body>" + "".join(draw.sample(noise, 3)) + wrap.format(inner) + "".join(draw.sample(noise, 3)) + "<footer>&copy; x</footer></body></html>"
        got, want = html_text.main_text(page).split("\n\n"), [t for _, t in body]
        right, found, wanted = right + sum(t in want for t in got), found + len(got), wanted + len(want)
    assert right / found > 0.99 and right / wanted > 0.99


def test_main_text_is_linear_in_nesting():
    for deep in ("<div>a" * 100_000, "<div class=ad>a" * 50_000, "<center>a<p>" * 50_000, "<ul><li>a" * 50_000, "<article>a" * 50_000, "</p></div>a" * 50_000):
        assert len(html_text.main_text(deep)) < 400_000
    assert html_text.main_text("<div>a" * 3) == "a\n\na\n\na"


def test_extract_text_frames(spark):
    df = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (2, None, None), (3, "v", "<p>" + "long " * 20000)], "page_id long, url string, html string").withColumn("text", F.lit(7))
    got = html_text.extract_text(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((r["page_id"], r["n_chars"]) for r in got.collect()) == [(1, len(html_text.main_text(PAGE))), (2, 0), (2, 0), (3, 99999)]
    assert html_text.extract_text(df.limit(0)).collect() == []


def test_token_counts(spark):
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256}
    df = spark.createDataFrame([(1, "ab c", "s", "en"), (2, None, None, None), (3, "", "s", "en")], "doc_id long, text string, source string, lang string")
    assert sorted(map(tuple, token_counts.count_tokens(df, ranks).collect())) == [(1, "s", "en", 3, 2), (2, None, None, 0, 0), (3, "s", "en", 0, 0)]


def brute_rollup(batches):
    state = {}
    for changes in batches:
        last = {}
        for c in sorted(changes, key=lambda c: (c[6], c[5], c[2] or "", c[3] or "", c[4])):
            last[c[0], c[1]] = c
        for k, c in last.items():
            state.pop(k, None)
            if c[5] == "upsert":
                state[k] = c
    out = {}
    for c in state.values():
        key = (c[2], c[3], c[1])
        docs, tokens = out.get(key, (0, 0))
        out[key] = docs + 1, tokens + c[4]
    return sorted((*k, *v) for k, v in out.items())


def test_rollup_against_brute_force(spark, tmp_path):
    draw = random.Random(8)
    batches = [[(draw.randrange(12), draw.choice(["v1", "v2"]), draw.choice(["a", "b"]), draw.choice(["en", "de"]), draw.randrange(100), draw.choice(["upsert", "upsert", "delete"]), draw.randrange(3)) for _ in range(25)] for _ in range(3)]
    kind = "doc_id long, version string, source string, lang string, tokens long, op string, seq long"
    rollup = token_counts.Rollup(spark, f"file://{tmp_path}/rollup")
    assert rollup.totals().collect() == []
    for i, changes in enumerate(batches):
        assert rollup.commit(f"b{i}", spark.createDataFrame(changes + changes[:3], kind))
        assert not rollup.commit(f"b{i}", spark.createDataFrame(changes, kind))
        assert sorted(map(tuple, rollup.totals().collect())) == brute_rollup(batches[: i + 1])
    assert rollup.commit("empty", spark.createDataFrame([], kind))
    assert sorted(map(tuple, rollup.totals().collect())) == brute_rollup(batches)
    with pytest.raises(Exception, match="unknown op"):
        rollup.commit("bad", spark.createDataFrame([(1, "v1", "a", "en", 1, "other", 0)], kind))
    assert len(rollup.commits()) == 4  # what failed left no trace


def test_rollup_compacts_and_expires(spark, tmp_path, monkeypatch):
    """With a snapshot every second commit the totals stay those of all batches, and a batch reads no deltas before it."""
    monkeypatch.setattr(token_counts, "COMPACT", 2)
    draw, kind = random.Random(9), "doc_id long, version string, source string, lang string, tokens long, op string, seq long"
    batches = [[(draw.randrange(9), "v", draw.choice(["a", "b"]), "en", draw.randrange(100), draw.choice(["upsert", "delete"]), 0) for _ in range(6)] for _ in range(5)]
    rollup = token_counts.Rollup(spark, f"file://{tmp_path}/rollup")
    for i, changes in enumerate(batches):
        assert rollup.commit(f"b{i}", spark.createDataFrame(changes, kind))
        rollup.expire()
        assert not rollup.commit("b0", spark.createDataFrame(changes, kind))
        assert sorted(map(tuple, rollup.totals().collect())) == brute_rollup(batches[: i + 1])
    assert len(rollup._recent()[2]) == 2 and len(list((tmp_path / "rollup" / "deltas").iterdir())) == 2


def test_count_tokens_edges(spark):
    ranks = {bytes([b]): b for b in range(256)}
    df = spark.createDataFrame([(1, "ab", "s", "en", 5), (1, "ab", "s", "en", 5), (None, "c" * 300_000, None, None, 6)], "doc_id long, text string, source string, lang string, tokens long").withColumn("words", F.lit("old"))
    assert sorted(map(tuple, token_counts.count_tokens(df, ranks).collect()), key=repr) == sorted([(1, "s", "en", 2, 1)] * 2 + [(None, None, None, 300_000, 1)], key=repr)
    assert token_counts.count_tokens(df.limit(0), ranks).collect() == []


def test_rollup_null_keys_and_orphans(spark, tmp_path):
    kind = "doc_id long, version string, source string, lang string, tokens long, op string, seq long"
    rollup = token_counts.Rollup(spark, f"file://{tmp_path}/rollup")
    (tmp_path / "rollup" / "totals" / "left-by-a-lost-attempt").mkdir(parents=True)
    rollup.commit("1", spark.createDataFrame([(None, "v", None, "en", 5, "upsert", 0), (1, None, "s", None, None, "upsert", 0)], kind))
    rollup.commit("2", spark.createDataFrame([(None, "v", None, "en", 7, "upsert", 0), (7, "v", "s", "en", 1, "delete", 0)], kind))
    assert sorted(map(tuple, rollup.totals().collect()), key=repr) == sorted([(None, "en", "v", 1, 7), ("s", None, None, 1, 0)], key=repr)


CONTROL = [*chat.CONTROLS, "\\", "|>", " ", "<", "|", "a", "[", "é", "\n"]


def test_format_and_read_back():
    draw = random.Random(5)
    for _ in range(4000):
        turns = [(draw.choice(["user", "assistant", "system", "tool", "", "a|b", "x\\"]), "".join(draw.choice(CONTROL) for _ in range(draw.randint(0, 6)))) for _ in range(draw.randint(0, 4))]
        text, loss = chat.format_turns(turns)
        assert chat.read_turns(text) == turns
        assert "".join(chat.unescape(text[a:b]) for a, b in loss) == "".join(x for r, x in turns if r == "assistant")
    for bad in ("", "<s>[INST] open", "<s>open"):
        with pytest.raises(ValueError):
            chat.read_turns(bad)


def test_branches_of_a_tree(spark):
    kind = "none boolean, conv long, node long, parent long, role string, text string, score double"
    tree = [(1, None, "user", "q", 0.0), (2, 1, "assistant", "a1", 1.0), (3, 1, "assistant", "a2", 5.0), (4, 2, "user", "u", 9.0), (5, 99, "user", "orphan", None)]
    rows = [(False, 1, *m) for m in tree] + [(False, 1, *tree[0])] + [(True, 0, 1, None, None, None, None)]
    rows += [(False, 2, i, i - 1 if i > 1 else None, "user" if i % 2 else "assistant", f"t{i}", 1.0) for i in range(1, 38)]
    df = spark.createDataFrame(rows, kind)
    got = {(r["none"], r["conv"], r["leaf"]): r for r in chat.format_branches(df).collect()}
    assert {k: (r["rank"], r["score"]) for k, r in got.items()} == {(False, 1, 4): (1, 10.0), (False, 1, 3): (2, 5.0), (False, 1, 5): (3, 0.0), (False, 2, 37): (1, 37.0), (True, 0, 1): (1, 0.0)}
    assert chat.read_turns(got[False, 1, 4]["text"]) == [("user", "q"), ("assistant", "a1"), ("user", "u")]
    assert chat.read_turns(got[False, 2, 37]["text"]) == [("user" if i % 2 else "assistant", f"t{i}") for i in range(1, 38)]
    assert chat.format_branches(df, top=1).count() == 3
    assert chat.format_branches(df.limit(0)).collect() == []
    with pytest.raises(ValueError, match="circle"):
        chat.format_branches(spark.createDataFrame([(False, 1, 1, 2, "u", "t", 0.0), (False, 1, 2, 1, "u", "t", 0.0)], kind))


def test_chat_format_edges(spark):
    df = spark.createDataFrame([(None, 1, "user", None), (4, None, "user", "first"), (4, 1, None, "x"), (4, 1, None, "x")], "conv_id long, turn long, role string, text string").withColumn("node", F.lit(1))
    got = {r["conv_id"]: chat.read_turns(r["text"]) for r in chat.chat_format(df).collect()}
    assert got == {None: [("user", "")], 4: [("user", "first"), ("", "x"), ("", "x")]}


def test_fixtures_themselves():
    assert fx.near([(1, "a b c d e"), (2, "A b c d e"), (3, "x")]) == [(1, 1, 1, True), (2, 1, 1, False), (3, 1, 3, True)]
