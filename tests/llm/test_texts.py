"""Pages, pieces, decontamination and the pipeline."""

import os
import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from spendlens import session
from spendlens.llm import decontaminate, html, html_samples, pieces_fst
from tests.llm.cases import documents, plain

pytestmark = pytest.mark.filterwarnings("ignore")


# --- pages -------------------------------------------------------------------------


@pytest.fixture(scope="module")
def weights():
    return html.Weights()


PARTS = "<h1>Tïtle</h1><p>One &amp; two  three.</p><p>fo<b>u</b>r</p>"
PARTS_TEXT = "Tïtle One & two three. four"
ROUND = {
    "plain": "{}",
    "article": "<html><head><title>t</title></head><body><nav><a href='/'>Home page</a></nav><article>{}</article>"
    "<footer>All rights reserved by the makers</footer></body></html>",
    "boxes": "<body><div class='top-menu'><a>One</a><a>Two</a></div><div id=cookie-banner>We use cookies here, yes"
    " we do</div><div class='content'>{}</div><div class=sidebar><p>Most read this week in town</p></div>"
    "<section class='comments'><p>I do not agree with any of this text at all.</p></section>",
    "inside": "<main>{}<div class='ad'>Buy this now and save a lot of money</div><script>if (a < b) x()</script>"
    "<style>p > b {{}}</style><form><label>Name of yours</label></form><!-- no <p>text</p> --></main>",
    "form around": "<form action='/'><nav>a b c</nav><article>{}</article></form>",
    "unclosed": "<body><article><b>{}<br>",
    "header": "<body><header><a href=/>The long name of the site</a></header><article><header>{}</header></article>",
}


@pytest.mark.parametrize("page", list(ROUND.values()), ids=list(ROUND))
def test_article_without_its_surroundings(weights, page):
    assert html.main_text(page.format(PARTS), weights) == PARTS_TEXT


@pytest.mark.parametrize("number", range(len(html_samples.PAGES)))
def test_labelled_pages(weights, number):
    page = html_samples.PAGES[number]
    bare = page.replace(html_samples.OPEN, "").replace(html_samples.CLOSE, "")
    labelled = page.split(html_samples.OPEN)[1].split(html_samples.CLOSE)[0]
    found = html.main_text(bare, weights)
    first = html.main_text(f"<article>{labelled}</article>", weights)
    assert found.startswith(first) and "Copyright" not in found


@pytest.mark.parametrize("text", ["", "<", "<a href=\"x", "<!-- x", "<script>x", "<p", "&#0; &bad; &amp", "</p></div>"])
def test_broken_pages_do_not_fail(weights, text):
    assert isinstance(html.main_text(text, weights), str)


def test_pages_of_a_table(spark):
    rows = [(1, "u", f"<article>{PARTS}</article>", "x"), (1, "u", f"<article>{PARTS}</article>", "x"),
            (2, None, None, "x"), (None, "v", "", "x"), (3, "w", "<p>" + "word " * 50_000, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    found = html.extract(pages).collect()
    assert sorted((str(r["page_id"]), r["n_chars"]) for r in found) == [
        ("1", len(PARTS_TEXT)), ("1", len(PARTS_TEXT)), ("2", 0), ("3", 249_999), ("None", 0),
    ]
    assert html.extract(pages.filter("false")).collect() == []


# --- pieces ------------------------------------------------------------------------

needs_model = pytest.mark.skipif(not os.path.exists(pieces_fst.DEFAULT_MODEL), reason="no tokenizer files")


@needs_model
def test_pieces_equal_the_reference_encoder():
    import sentencepiece

    theirs = sentencepiece.SentencePieceProcessor(model_file=pieces_fst.DEFAULT_MODEL)
    machine = pieces_fst.Transducer(pieces_fst.read_model())
    rng = random.Random(6)
    letters = " \n\tabcthe<>0129▁ é中😀\x00.,-'A"
    for i in range(3_000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))
        if i % 3 == 0:
            text = " " * rng.randint(0, 40) + text.replace("a", "  ")
        ids = machine.encode(text)
        assert np.frombuffer(ids, pieces_fst.ID).tolist() == theirs.encode(text), text
        assert machine.decode(ids) == text.replace("▁", " ").encode()


def test_unigram_takes_the_least_path():
    ids = {"▁": 0, "a": 1, "b": 2, "ab": 3, "▁a": 4, "▁ab": 5}
    scores = {"▁": -1.0, "a": -2.0, "b": -2.0, "ab": -2.5, "▁a": -1.5, "▁ab": -9.0}
    model = pieces_fst.Model(ids, scores, (), 9, tuple(b"" for _ in range(10)), True, True, "test")
    machine = pieces_fst.Transducer(model)
    assert np.frombuffer(machine.encode("ab"), pieces_fst.ID).tolist() in ([0, 3], [4, 2])
    assert np.frombuffer(machine.encode("aab"), pieces_fst.ID).tolist() == [4, 3]
    assert np.frombuffer(machine.encode("q"), pieces_fst.ID).tolist() == [0, 9]


@needs_model
def test_pieces_of_a_table(spark):
    docs = documents(spark).select("doc_id", "text").na.fill("", ["text"])
    found = pieces_fst.encode(docs).collect()
    assert len(found) == docs.count() and all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in found)
    assert pieces_fst.encode(docs.filter("false")).collect() == []


# --- decontamination ---------------------------------------------------------------


def distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, x in enumerate(text, 1):
            new.append(min(new[j - 1] + 1, row[j] + 1, row[j - 1] + (c != x)))
        row = new
    return min(row)


def test_items_without_an_id_are_matched(spark):
    docs = spark.createDataFrame([(1, "so the river runs down to the sea"), (2, "none")], "doc_id long, text string")
    items = [(None, "The river runs down."), (None, "to the sea"), (7, "the sea")]
    table = spark.createDataFrame(items, "item_id long, text string")
    for block in (decontaminate.BLOCK_BYTES, 20):
        got = decontaminate.matches(docs, table, block_bytes=block).collect()
        assert sorted(str(r["item_id"]) for r in got) == ["7", "None", "None"]
        assert [r["doc_id"] for r in decontaminate.clean(docs, table.filter("item_id IS NULL"), block_bytes=block).collect()] == [2]


def test_matches_equal_brute_force(spark):
    rng = random.Random(9)
    line = lambda n: " ".join(rng.choice(["stone", "river", "äpfel", "the", "of", "road"]) for _ in range(n))
    items = [(i, line(rng.randint(6, 14))) for i in range(12)] + [(50, ""), (51, None), (52, "a.b"), (0, line(8))]
    texts = []
    for i in range(60):
        item = items[i % 12][1]
        harmed = list(item)
        for _ in range(rng.randint(0, 8)):
            harmed[rng.randrange(len(harmed))] = rng.choice("xyz ")
        texts.append((i, f"{line(4)} {''.join(harmed).upper()}, {line(5)}"))
    texts += [(100, None), (101, ""), (102, "x A-B! y"), (None, items[3][1])]
    docs = spark.createDataFrame([(i, t or "") for i, t in texts], "doc_id long, text string").repartition(3)
    table = spark.createDataFrame(items, "item_id long, text string")
    expected = set()
    for i, t in texts:
        text = decontaminate.normalised((t or "").encode())
        for item_id, item in items:
            plain_item = decontaminate.normalised((item or "").encode())
            least = distance(plain_item, text) if plain_item else 1
            if plain_item and least <= decontaminate.budget(len(plain_item)):
                expected.add((i, item_id, least))
    for block in (decontaminate.BLOCK_BYTES, 200):
        got = decontaminate.matches(docs, table, block_bytes=block).collect()
        assert {(r["doc_id"], r["item_id"], r["distance"]) for r in got} == expected
        kept = decontaminate.clean(docs, table, block_bytes=block)
        hit = [i for i, _, _ in expected]
        assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(i) for i, _ in texts if i not in hit)
    assert decontaminate.matches(docs, table.filter("false")).collect() == []
    assert decontaminate.clean(docs.filter("false"), table).collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_bit_parallel_distance(seed):
    rng = random.Random(seed)
    for _ in range(200):
        pattern = "".join(rng.choice("ab c") for _ in range(rng.randint(1, 90)))
        text = "".join(rng.choice("ab c") for _ in range(rng.randint(0, 60)))
        masks = {}
        for i, letter in enumerate(pattern):
            masks[letter] = masks.get(letter, 0) | 1 << i
        assert decontaminate.least_distance(masks, len(pattern), text)[0] == distance(pattern, text)


@needs_model
def test_workers_keep_nothing_of_the_texts_they_have_encoded(spark):
    def kept(batches):
        for _ in batches:
            pass
        held = [len(m.known) + len(m.older) + len(m.arcs) for m in pieces_fst._machines.values()]
        yield pa.RecordBatch.from_arrays([pa.array([sum(held)])], ["held"])

    docs = spark.range(400).repartition(8).selectExpr("id AS doc_id", "concat('word', id, ' other', id * id) AS text")
    assert pieces_fst.encode(docs).filter("round_trip").count() == 400
    assert {r["held"] for r in spark.range(8).repartition(8).mapInArrow(kept, "held long").collect()} == {0}


# --- pipeline ----------------------------------------------------------------------


def test_pipeline_gives_python_workers_little_at_a_time(spark, monkeypatch):
    def largest(docs, *rest):
        def run(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["n", "size"])

        return docs.mapInArrow(run, "n long, size long")

    docs = spark.range(64).repartition(1).selectExpr("id AS doc_id", "repeat('abc ', 1 << 17) AS text")
    monkeypatch.setattr(corpus_pipeline.substring, "rewritten", largest)
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(setting)
    try:
        found = corpus_pipeline.drop_repeated_passages(spark, docs, "").collect()
        assert sum(r["n"] for r in found) == 64
        assert max(r["size"] for r in found) <= session.BATCH_BYTES + (1 << 20)
        spark.conf.set(setting, f"{1 << 20}b")  # the user's own
        assert max(r["n"] for r in corpus_pipeline.drop_repeated_passages(spark, docs, "").collect()) <= 3
    finally:
        spark.conf.unset(setting)


@needs_model
def test_pipeline(spark, tmp_path):
    docs = documents(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = [(i, int(b"idiot" in t)) for i, t in plain(docs) if i is not None]
    spark.createDataFrame(rows, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    item = "a passage that some benchmark holds and nobody else should have at all"
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    current = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        current = stage(spark, current, str(tmp_path))
        assert current.schema.simpleString() == docs.schema.simpleString(), name
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(found) == current.count() and all(r["round_trip"] for r in found)
    none = docs.filter("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).collect() == []


ONE = "The first paragraph of this article has some nineteen words in it so that the probe is quite fair."
TWO = "And the second paragraph goes on for eighteen words more, which must all be in the text too."


@pytest.mark.parametrize(
    "between",
    [
        f'<div class="ad">{"buy now " * 7}</div>', f'<div class="ad">{"buy now cheap " * 40}</div>',
        f'<div class="related"><ul>{"<li><a href=x>more of this</a></li>" * 30}</ul></div>',
        '<svg width="3"/>', "<svg><text>3 km</text></svg>", '<object data="x">', "<noscript>", "<iframe/>",
    ],
)
def test_the_whole_article_is_kept(between):
    page = f'<body><nav><a href="/">Home</a></nav><article><p>{ONE}</p>{between}<p>{TWO}</p></article><footer>c</footer>'
    assert html.main_text(page, html.Weights()) == f"{ONE} {TWO}"
    assert html.main_text(f"<svg/>{page}", html.Weights()) == f"{ONE} {TWO}"


def test_many_elements_without_an_end_take_linear_time():
    page = "<select>" * 20_000 + f"<article><p>{ONE}</p><p>{TWO}</p></article>"
    assert ONE in html.main_text(page, html.Weights())
    assert html.main_text(f"<article><p>{ONE}</p><script>var a = '<p>{TWO}</p>'", html.Weights()) == ONE


def test_best_region_equals_all_regions():
    rng = random.Random(9)
    for _ in range(300):
        gains = [rng.choice([-2.5, -1.0, -0.25, 0.0, 0.5, 1.0, 2.0]) for _ in range(rng.randint(0, 25))]
        first, last = html.best_region(gains)
        sums = [sum(gains[a:b]) for a in range(len(gains)) for b in range(a, len(gains) + 1)]
        assert sum(gains[first:last]) == max(sums, default=0.0)
