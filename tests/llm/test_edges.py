"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

from pagemill.llm import cws, decontam, langid, pii, rules, simhash, spviterbi, tokenstore, toxicity, wrapper

LONG = "the cat sat on the mat, and it was good. " * 4000
ROWS = [
    (1, "The cat sat on the mat and looked at the dog for a long time today", "en"), (2, None, "en"), (3, "", None), (4, "   \n\t ", "de"), (5, LONG, "en"), (6, "x" * 50_000, None),
    (7, "Der Hund und die Katze sind im Haus und schlafen dort den ganzen Tag", "de"), (7, "Der Hund und die Katze sind im Haus und schlafen dort den ganzen Tag", "de"),
    (8, "mail bob@example.com, +1 (555) 123-4567 or 4111 1111 1111 1111 at 10.0.0.1", "en"), (None, "no id here", "en"), (9, "\x01\x02\x00 odd ▁ marks <|endoftext|>", "en"), (10, "999999", None),
]


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.createDataFrame(ROWS, "doc_id bigint, text string, lang string")
    extra = {c: F.lit("clash") for c in ("fp", "score", "block", "row", "anchor", "terms", "hash", "source", "y", "place", "n", "root", "k")}
    return d.withColumns(extra).withColumn("n_chars", F.length("text").cast("bigint")).repartition(3)


def _labels(spark, column):
    return spark.createDataFrame([(1, 1), (7, 0), (8, None), (None, 1), (99, 1), (5, 1)], f"doc_id bigint, {column} int")


OPERATORS = {
    "pii": lambda d: pii.detect(d, pii.fit_on(d)),
    "redact": lambda d: pii.redact(d, pii.fit_on(d)),
    "toxicity": lambda d: toxicity.score(d, toxicity.fit(d, _labels(d.sparkSession, "toxic"), F.lit(True))),
    "tokens": tokenstore.store_documents,
    "language": lambda d: langid.identify(d, langid.fit(d, F.lit(True))),
    "cws": lambda d: cws.with_likeness(d, 8),
    "simhash": simhash.components,
    "quality": lambda d: rules.score(d, rules.fit(d, _labels(d.sparkSession, "quality"), F.lit(True))),
    "decontam": lambda d: decontam.contamination(d, d.select(F.col("doc_id").alias("item_id"), "text")),
    "sentencepiece": spviterbi.encode,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_all_rows_come_back(docs, name):
    got = OPERATORS[name](docs).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((i is None, i or 0) for i, *_ in ROWS)
    assert len({tuple(str(v) for k, v in r.asDict().items() if k not in ("start", "near_next", "edited_sha256", "edited_fingerprint", "near_edited")) for r in got if r.doc_id == 7}) == 1


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(docs, name):
    assert OPERATORS[name](docs.limit(0)).count() == 0


def test_pages(spark):
    page = lambda body: f"<html><body><nav><a href=x>menu</a></nav><div class='ad banner'>buy</div><article>{body}</article><footer>end</footer></body></html>"
    rows = [
        (1, "http://a.com/1", page("<h1>One</h1><p>first &amp; <b>best</b><br><p>second   line")), (2, "http://a.com/2", page("<h1>Two</h1><p>other<p>more</p>")), (3, "http://a.com/3", None), (4, None, page("<p>alone</p>")),
        (5, "b", ""), (6, "http://a.com/2", page("<h1>Two</h1><p>other<p>more</p>")), (7, "http://c.org/", "plain <text & more"), (8, "http://c.org/x", "<p>" * 3000 + "deep"), (None, "http://a.com/9", page("<aside>x</aside><p>y<script>z()</script></p><div id=comments>first!</div>")),
    ]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumns({"host": F.lit("x"), "path": F.lit("y"), "h": F.lit(1)})
    got = {r.page_id: r for r in wrapper.main_text(pages, wrapper.wrappers(pages)).collect()}
    assert got[1].text == "One\nfirst & best\nsecond line" and got[2].text == got[6].text == "Two\nother\nmore" and got[3].text == got[5].text == "" and got[4].text == "alone"
    assert got[8].text == "deep" and got[None].text == "y" and got[1].n_chars == len(got[1].text)
    assert got[7].text == "plain <text & more"  # no tag
    assert wrapper.main_text(pages.limit(0), wrapper.wrappers(pages.limit(0))).count() == 0


def test_wrapper_is_learnt():
    page = lambda head, body: f"<html><body><div><div>Site name</div><div>{head}</div></div><div><div><p>{body}</p><p>{body} again and again</p></div></div><div>All rights</div></body></html>"
    pages = [page("Home", f"text {w} of the page is long enough") for w in ("one", "two", "three")]
    path = wrapper.induce(pages)
    assert path and wrapper.extract(pages[0], path) == "text one of the page is long enough\ntext one of the page is long enough again and again"
