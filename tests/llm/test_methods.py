"""The methods against brute force, in small blocks too, so that what large data need is run here."""

import itertools
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagemill.llm import cws, decontam, langid, pii, queries, rules, similar, toxicity, wrapper
from pagemill.llm.common import connected_components, hash_sample, held_out, labelled_sample, table

# benchmark decontamination


def some_texts(seed, n, words=30, vocab=9):
    rng = np.random.default_rng(seed)
    return [" ".join(f"w{k}" for k in rng.zipf(1.5, int(rng.integers(0, words))) % vocab) for _ in range(n)]


def plain_near(docs, items, window, rare, slop):
    lists = [t.split() for t in docs]
    counts = Counter(w for ws in lists for w in ws)
    phrases = {tuple(ws[i : i + window]) for ws in (t.split() for t in items) if ws for i in range(max(1, len(ws) - window + 1))}
    out = [0] * len(docs)
    for p in phrases:
        few = sorted(range(len(p)), key=lambda j: counts[p[j]])[:rare]
        if len(p) < rare:
            continue
        for d, ws in enumerate(lists):
            for at, w in enumerate(ws):
                if w == p[few[0]] and all(any(x == p[j] and abs(q - (at + j - few[0])) <= slop for q, x in enumerate(ws)) for j in few[1:]):
                    out[d] += 1
    return out


@pytest.mark.parametrize("segment_words", [1, 60, 10**6])
def test_near_matches_equal_brute_force(spark, segment_words):
    docs, items = some_texts(1, 40), some_texts(2, 6, 12)
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string").repartition(3)
    phrases = decontam.Phrases(list(enumerate(items)), 5)
    index = decontam.build_index(frame, segment_words)
    got = {r.doc_id: r.n_near for r in decontam.search(index, phrases, slop=1).collect()}
    assert [got[i] for i in range(len(docs))] == plain_near(docs, items, 5, 3, 1) and sum(got.values()) > 50
    exact = {(r.doc_id, r.item_id, r.word, r.n_words) for r in decontam.matches(index, phrases).filter("kind = 'exact'").collect()}
    want = set()
    for i, ws in enumerate(t.split() for t in items):
        for k in range(max(1, len(ws) - 4)) if ws else ():
            cut = ws[k : k + 5]
            want |= {(d, str(i), at, len(cut)) for d, t in enumerate(docs) for at in range(len(t.split()) - len(cut) + 1) if t.split()[at : at + len(cut)] == cut}
    assert exact == want and want


def test_proximity_stays_in_a_document(spark):
    frame = spark.createDataFrame([(1, "alpha"), (2, "beta gamma"), (3, "alpha x beta gamma")], "doc_id bigint, text string").coalesce(1)
    found = decontam.contamination(frame, spark.createDataFrame([("a", "alpha beta gamma")], "item_id string, text string"))
    assert {r.doc_id: r.n_near for r in found.collect()} == {1: 0, 2: 0, 3: 1}


def test_blocks_of_the_benchmark(spark):
    docs = [*some_texts(3, 60, 80, 7), None, ""]
    items = [*some_texts(4, 8, 40, 7), None, "!!", "w1"]
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string").repartition(2)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    one, many = (sorted((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in decontam.contamination(frame, bench, 4, n).collect()) for n in (10**6, 7))
    assert one == many and sum(r[2] for r in one) > 100 and len(list(decontam.phrase_blocks(bench, 4, 7))) > 5
    assert len({r[3] for r in one}) > 3


def test_split_is_words_of():
    import pyarrow as pa

    texts = ["A b-c", None, "", "  ", "é日 x\x00y z ", "1,2"]
    sizes, words = decontam._split(pa.array(["skipped", *texts])[1:])
    assert sizes.tolist() == [len(decontam.words_of(t)) for t in texts] and words.cast(pa.binary()).to_pylist() == [w for t in texts for w in decontam.words_of(t)]


# personal data


@given(st.text(alphabet=st.one_of(st.characters(), st.sampled_from("0123456789.@+²٣ ()-")), max_size=80))
@settings(max_examples=400, deadline=None)
def test_any_text_has_spans(text):
    model = pii.fit([])
    assert all(0 <= s < e <= len(text) for _, s, e, _ in pii.find([text, "see 1.2.3.² now"], model)[0])


def marginals_by_enumeration(model, g):
    u = g.x @ model.unary
    k, total = u.shape[1], np.zeros_like(u)
    for code in np.ndindex(*[k] * len(u)):
        links = sum(model.chain[code[a], code[b]] for a, b in g.chain) + sum(model.skip[code[a], code[b]] for a, b in g.skip)
        w = np.exp(sum(u[i, c] for i, c in enumerate(code)) + links)
        for i, c in enumerate(code):
            total[i, c] += w
    return total / total.sum(1, keepdims=True)


@pytest.mark.parametrize(("text", "close"), [("1234 and 1234 and 1234", 1e-6), ("1234 77 and 99 1234", 1e-6), ("1234 77 99 1234", 0.03), ("555 1234 and 1234 555", 0.05)])
def test_messages_over_skip_links(text, close):
    """Exact where the links are a tree, near where they have a loop."""
    rng = np.random.default_rng(5)
    k = len(pii.KINDS) + 1
    model = pii.Field(rng.normal(size=(len(pii.FEATURES), k)), 0.7 * rng.normal(size=(k, k)), 1.2 * np.eye(k))
    g = pii.graph_of([text])
    assert len(g.skip)
    assert np.abs(model.marginals(g, rounds=200) - marginals_by_enumeration(model, g)).max() < close


def test_skip_links_carry_a_label_to_a_repeat():
    k = len(pii.KINDS) + 1
    base = np.zeros((len(pii.FEATURES), k))
    model = pii.Field(base.copy(), np.zeros((k, k)), 2.0 * np.eye(k))
    model.unary[pii.FEATURES.index("plus_first"), 4] = 6.0
    p = model.marginals(pii.graph_of(["call +1555123 or (1555123) soon"]))
    lone = pii.Field(model.unary, model.chain, np.zeros((k, k))).marginals(pii.graph_of(["call +1555123 or (1555123) soon"]))
    assert p[1].argmax() == 4 and p[1, 4] > 0.55 and abs(lone[1, 4] - 1 / k) < 1e-9


# near-duplicates of a similarity


def near_texts(seed, sizes, n_words=120):
    """Groups of texts that differ from a base, each in its own share of places."""
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(6000)]
    rows = []
    for size in sizes:
        base = list(rng.choice(words, n_words))
        for _ in range(size):
            w = list(base)
            for k in rng.integers(0, n_words, int(rng.integers(0, 8))):
                w[k] = str(rng.choice(words))
            rows.append((len(rows), " ".join(w)))
    return rows


def plain_groups(rows):
    sets = {i: set(similar.shingles(t).tolist()) for i, t in rows}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    n_pairs = 0
    for i, j in itertools.combinations(sets, 2):
        if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            n_pairs += 1
            p, q = sorted((find(i), find(j)))
            up[q] = p
    return {i: find(i) for i in sets}, n_pairs


@pytest.mark.parametrize("blocks", [(8192, 100_000), (7, 900)])
def test_groups_equal_exact_similarity(spark, blocks):
    """Crowded anchors and families are dealt over many blocks; what is joined is the same."""
    rows = near_texts(21, [150, 40, 3, 2, 2, *[1] * 20])
    want, n_pairs = plain_groups(rows)
    got = {r.doc_id: r.component_id for r in similar.groups(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4), block_texts=blocks[0], block_shingles=blocks[1]).collect()}
    assert got == want and n_pairs > 1000


def test_recall_by_similarity(spark):
    """Pairs of their own, without a crowd around them: at least 0.9 of them are found, also just above 0.8."""
    rng = np.random.default_rng(22)
    words = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(9000)]
    rows, pairs = [], []
    for _ in range(700):
        base = list(rng.choice(words, 150))
        other = list(base)
        for k in rng.integers(0, 150, int(rng.integers(1, 5))):
            other[k] = str(rng.choice(words))
        a, b = " ".join(base), " ".join(other)
        x, y = (set(similar.shingles(t).tolist()) for t in (a, b))
        if len(x & y) >= 0.8 * len(x | y):
            pairs.append((len(rows), len(x & y) / len(x | y)))
        rows += [(len(rows), a), (len(rows) + 1, b)]
    got = {r.doc_id: r.component_id for r in similar.groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    found = defaultdict(list)
    for i, s in pairs:
        found["0.80 to 0.85" if s < 0.85 else "above"].append(got[i + 1] == i)
    assert len(found["0.80 to 0.85"]) > 60 and all(np.mean(v) >= 0.9 for v in found.values())
    twins = {i for i, _ in pairs}
    assert all(got[i] == i for i, _ in rows if i % 2 == 0) and all(got[i + 1] == i + 1 for i, _ in rows[::2] if i not in twins)


@pytest.mark.parametrize("shape", ["path", "star", "random", "dense"])
def test_components_of_any_shape(spark, shape):
    rng = np.random.default_rng(9)
    edges = {
        "path": [(i, i + 1) for i in range(300)] + [(1000, 1001)], "star": [(0, i) for i in range(1, 300)] + [(5, 5)], "random": [tuple(map(int, p)) for p in rng.integers(0, 400, (300, 2))],
        "dense": [(i, j) for i, j in itertools.combinations(range(40), 2)] + [(100, 99), (39, 100)],
    }[shape]
    up = {n: n for e in edges if e[0] != e[1] for n in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            p, q = sorted((find(a), find(b)))
            up[q] = p
    got = [tuple(r) for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()]
    assert dict(got) == {n: find(n) for n in up} and len(got) == len(up)


# stages of the pipeline


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").withColumn("fp", F.lit("clash"))


def test_contaminated_rows_go_by_their_own_text(spark, tmp_path):
    import corpus_pipeline as C

    passage = " ".join(f"word{i}" for i in range(20))
    spark.createDataFrame([(1, passage)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(1, passage), (1, "a clean text under the same id"), (None, passage), (None, "clean without id"), (2, None), (2, ""), (3, "clean"), (3, "clean")]
    got = sorted(((r.doc_id or 0), r.text or "") for r in C.decontaminate(spark, documents(spark, rows), str(tmp_path)).collect())
    assert got == [(0, "clean without id"), (1, "a clean text under the same id"), (2, ""), (2, ""), (3, "clean"), (3, "clean")]
    assert C.decontaminate(spark, documents(spark, rows[:1] + rows[6:7]), str(tmp_path)).columns == ["doc_id", "text", "lang", "source", "n_chars", "fp"]


@pytest.mark.parametrize("name", ["language", "near_dedup", "decontaminate", "personal_data", "token_ids"])
def test_stages_on_odd_rows(spark, name):
    import corpus_pipeline as C

    long = "The quick brown fox jumps over the lazy dog and runs away. " * 4000
    rows = [(1, "The committee met in the town hall and talked about the new school"), (2, None), (3, ""), (3, ""), (None, " \n"), (4, long), (4, long), (5, "mail to a.b@example.org or call"), (None, "no id")]
    stage, d = dict(C.STAGES)[name], documents(spark, rows).repartition(3)
    got = stage(spark, d, "/root/testdata/sf0.001").collect()
    texts = sorted(r.text or "" for r in got) if name != "token_ids" else []
    if name == "language":
        assert not any(not t.strip() for t in texts)
    elif name == "near_dedup":
        assert texts == sorted(["", rows[0][1], long, "mail to a.b@example.org or call", "no id"])
    elif name == "decontaminate":
        assert len(got) == len(rows)
    elif name == "personal_data":
        assert len(got) == len(rows) and "mail to <EMAIL> or call" in texts and sum(r.text is None for r in got) == 1
    else:
        assert len(got) == len(rows) and all(r.decoded for r in got)
    assert stage(spark, d.limit(0), "/root/testdata/sf0.001").count() == 0


# main text


def page(body, head="", foot=""):
    return f"<html><head><title>t</title></head><body>{head}<div id=main>{body}</div>{foot}</body></html>"


def texts_of(pages):
    path = wrapper.induce(pages)
    return [wrapper.extract(p, path) for p in pages]


def story(k, n=4):
    return "".join(f"<p>Story {k} goes on with sentence {i} of its own</p>" for i in range(n + k % 3))


def told(k, n=4):
    return [f"Story {k} goes on with sentence {i} of its own" for i in range(n + k % 3)]


@pytest.mark.parametrize("n", [10, 63, 64, 65, 200])
def test_template_inside_the_root_goes(n):
    """A constant block among the article's own, however many siblings it has, before, between and after."""
    staff = "<p>Written by our staff desk every day of the week</p>"
    got = texts_of([page(f"<article><h1>Title {k}</h1>{staff}{story(k, n)}<div class=x>Read our rules before you write to us</div></article>") for k in range(5)])
    assert got == ["\n".join([f"Title {k}", *told(k, n)]) for k in range(5)]


def test_template_without_article_element():
    got = texts_of([page(f"<div><div>The daily paper</div>{story(k)}</div><div>Printed in the old town</div>", "<div>Home</div>", "<div>All rights</div>") for k in range(6)])
    assert got == ["\n".join(told(k)) for k in range(6)]


def test_copies_of_an_article_are_no_template():
    same = "".join(f"<p>Sentence {i} that all copies share</p>" for i in range(9))
    got = texts_of([page(f"<article><h1>Copy</h1>{same}<p>edit {k}</p></article>") for k in range(4)])
    assert all(g.startswith("Copy\nSentence 0") and g.endswith(f"edit {k}") and g.count("\n") == 10 for k, g in enumerate(got))


def test_passages_of_some_pages_stay():
    licence = "<p>This text may be used under the terms of the common licence</p>"
    got = texts_of([page(f"<article>{story(k)}{licence if k % 2 else ''}</article>") for k in range(6)])
    assert all(("common licence" in g) == bool(k % 2) for k, g in enumerate(got))


@pytest.mark.parametrize("depth", [10, 399, 401, 5000])
def test_deep_nesting(depth):
    html = "<body>" + "<div>" * depth + "<nav>menu</nav><p>deep text</p>" + "</div>" * depth + "<p>end</p></body>"
    assert wrapper.extract(html, None) == "deep text\nend"


def test_words_of_classes():
    inside = "<article><h2 class=section-header>Heading</h2><div class=alert>Storm ahead</div><p class='form'>In due form</p><div class=side>A side note</div><p class=page-title>Page</p><div class=cookie-notice>We use cookies</div><section id=comments><p>First!</p></section><div class='ad top'>Buy</div></article>"
    around = "<div class=header>Site</div><div class=alert>Read this</div><div class='menu'>A B</div><aside>links</aside><form>send</form>"
    assert wrapper.extract(f"<body>{around}{inside}</body>", None) == "Heading\nStorm ahead\nIn due form\nA side note\nPage"
    assert wrapper.extract(f"<body>{around}<p>only text</p></body>", None) == "only text"


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ('<p class="x>b</p><p>c</p>', "b\nc"), ("<p class='x>b", "b"), ("a <b>c</b <i>d</i>", "a cd"), ("1 < 2 and 3 > 2", "1 < 2 and 3 > 2"), ("a<p title='1>2'>b</p>", "a\nb"), ("x <text & more", "x <text & more"), ("x<div class=\"y", "x"), ("x<div", "x"),
        ("&lt;p&gt; &amp;amp; &eacute;&#8364;&nbsp;z", "<p> &amp; é€\xa0z"), ("<p>a<!-- no <p>x</p> --> b</p>", "a b"), ("<p>a <script>if (a<b) x('</p>')</script> b</p>", "a b"), ("<ul><li>one<li>two</ul>tail", "one\ntwo\ntail"), ("<p>a\n\t b<br/>c</p>", "a b c"), (None, ""), ("", ""),
    ],
)
def test_broken_markup(html, text):
    assert wrapper.extract(html, None) == text


@given(st.text(alphabet="<>/=\"' ab!-pdiv&;\n", max_size=80))
@settings(max_examples=300, deadline=None)
def test_any_markup_is_parsed(html):
    lines = wrapper.extract(html, None).split("\n")
    assert all(line == line.strip() for line in lines)


def test_long_pages(spark):
    many = "".join(f"<p>line {i} of a very long page</p>" for i in range(20_000))
    rows = [(i, f"http://long.org/{i}", f"<body><nav>x</nav><article>{many}<p>{i}</p></article></body>") for i in range(3)] + [(9, "http://long.org/0", f"<body><nav>x</nav><article>{many}<p>0</p></article></body>")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r.page_id: r for r in wrapper.main_text(pages, wrapper.wrappers(pages)).collect()}
    assert got[0].text == got[9].text and all(got[i].text.count("\n") == 20_000 and got[i].n_chars == len(got[i].text) and got[i].text.endswith(f"\n{i}") for i in range(3))


# scores by the plainest means


@pytest.fixture(scope="module")
def small(spark):
    import pandas as pd

    d = "/root/testdata/sf0.001"
    return d, pd.read_parquet(f"{d}/documents.parquet").sort_values("doc_id")


def rows_of(spark, name, d):
    return queries.QUERIES[name](spark, d).toPandas().set_index("doc_id")


def rest(i, parts):
    return zlib.crc32(str(i).encode()) % parts


def test_toxicity_query_by_plain_convolution(spark, small):
    d, docs = small
    net = toxicity.fit(table(spark, d, "documents"), table(spark, d, "labels"), ~held_out(F.col("doc_id"), 4, 2))
    got = rows_of(spark, "op2_toxicity", d)

    def plain(text):
        x = [net.emb[toxicity.features(w)].astype(np.float64).sum(0) for w in decontam.words_of(text)]
        x += [np.zeros(toxicity.DIM)] * (max(toxicity.WIDTHS) - len(x))
        z, at = float(net.out_bias[0]), 0
        for i, w in enumerate(toxicity.WIDTHS):
            for k in range(toxicity.FILTERS):
                cols = [at + o * toxicity.FILTERS + k for o in range(w)]
                best = max(sum(float(x[p + o] @ net.conv[:, c]) for o, c in enumerate(cols)) for p in range(len(x) - w + 1))
                z += max(best + float(net.bias[i * toxicity.FILTERS + k]), 0) * float(net.out[i * toxicity.FILTERS + k])
            at += w * toxicity.FILTERS
        return 1 / (1 + np.exp(-z))

    few = docs.iloc[::4]
    assert max(abs(got.score[i] - plain(t)) for i, t in zip(few.doc_id, few.text)) < 1e-4
    assert all(got.held_out[i] == (rest(i, 4) == 2) and got.predicted[i] == (got.score[i] >= 0.3) for i in docs.doc_id)
    assert all(got.flagged[i] == (got.score[i] >= net.thresholds.get(lang, toxicity.THRESHOLD)) for i, lang in zip(docs.doc_id, docs.lang))


def test_thresholds_are_of_rows_that_were_not_learnt(spark):
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(200)]
    rows = [(i, " ".join([*rng.choice(words, 20), *(["zorgon"] if i % 3 == 0 else [])]), "en") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(400)], "doc_id bigint, toxic int")
    seen = []
    train, toxicity.train = toxicity.train, lambda texts, y: seen.append(set(texts)) or train(texts, y)
    try:
        net = toxicity.fit(docs, labels, F.lit(True))
    finally:
        toxicity.train = train
    assert [250 < len(s) < 370 for s in seen] == [True, False] and len(seen[1]) == 400 and 0 < net.thresholds["en"] < 1


def test_language_query_by_plain_compression(spark, small):
    import zstandard

    d, docs = small
    dictionaries = langid.fit(table(spark, d, "documents"), ~held_out(F.col("doc_id"), 5, 0))
    got = rows_of(spark, "op4_language", d)
    names = sorted(dictionaries)
    for i, t in zip(docs.doc_id.iloc[::2], docs.text.iloc[::2]):
        raw, sizes = t.lower().encode(), []
        for name in names:
            held = zstandard.ZstdCompressionDict(dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            packer = zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes.append(sum(len(packer.compress(raw[k : k + langid.BLOCK])) for k in range(0, len(raw), langid.BLOCK)))
        if any(c.isalpha() for c in t):
            assert got.lang_pred[i] == names[sizes.index(min(sizes))] and abs(got.score[i] - 1 / sum(np.exp((min(sizes) - s) / 2) for s in sizes)) < 1e-9
        else:
            assert (got.lang_pred[i], got.score[i]) == ("und", 0.0)
    assert all(got.held_out[i] == (rest(i, 5) == 0) for i in docs.doc_id)


def plain_statistics(t):
    import regex

    words, lines, n = regex.split(r"[ \t\n\x0B\f\r]+", t.strip(" ")), t.split("\n"), max(len(t), 1)
    share = lambda pattern: len(regex.sub(pattern, "", t)) / n
    return [
        np.log1p(len(t)), n / len(words), share(r"[^\p{Lu}]+"), share(r"[^\p{L}]+"), share("[^0-9]+"), share("[^.,]+"), share("[^!?]+"), share("[^|]+"), share(r"[\p{L}0-9 \t\n\x0B\f\r.,!?|]+"),
        len(set(words)) / len(words), len(set(lines)) / len(lines), len(words) / len(lines),
    ]


def test_quality_query_by_plain_rules(spark, small):
    d, docs = small
    model = rules.fit(table(spark, d, "documents"), table(spark, d, "labels"), ~held_out(F.col("doc_id"), 5, 0))
    got = rows_of(spark, "op7_quality", d)
    for i, t in zip(docs.doc_id, docs.text):
        x, z = plain_statistics(t), model.intercept
        for rule, w in zip(model.rules, model.weights):
            z += w * all(x[s] > bound if above else x[s] <= bound for s, above, bound in rule)
        assert abs(got.score[i] - 1 / (1 + np.exp(-z))) < 1e-9
    assert all(got.held_out[i] == (rest(i, 5) == 0) and got.predicted[i] == (got.score[i] >= 0.3) for i in docs.doc_id) and model.rules


def test_samples_are_bounded(spark):
    """Repeated ids, repeated rows, null ids and huge texts do not swell what reaches the driver."""
    rows = [(i % 7 if i % 3 else None, "x" * 60_000 if i == 1 else f"text {i}") for i in range(4000)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(7)] * 2, "doc_id bigint, y int")
    got = labelled_sample(docs, labels, "y", F.lit(True), 5)
    assert len(got) <= 7 and all(len(r.text) < 50_000 for r in got)
    assert 50 < hash_sample(docs.select("doc_id", "text"), 100).count() <= 200  # null ids are chosen one by one


def test_edited_texts_and_likeness_in_blocks(spark):
    """Many blocks give what one gives, and likeness is near the weighted Jaccard similarity."""
    texts = some_texts(31, 60, 60, 25)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    one, many = ({r.doc_id: r for r in cws.fingerprints(frame, 96, n).collect()} for n in (1, 13))
    assert all((one[i].own, one[i].other, one[i].edited_sha256) == (many[i].own, many[i].other, many[i].edited_sha256) for i in one)
    assert len({r.block for r in many.values()}) > 8
    errors = []
    for i, t in enumerate(texts):
        nxt = texts[(i + 1) % len(texts)]
        cut = len(t) // 4
        a, b = Counter(t.split()), Counter((t[: len(t) - cut] + nxt[:cut]).split())
        if a and b:
            errors.append(np.mean([x == y for x, y in zip(one[i].own, one[i].other)]) - sum((a & b).values()) / sum((a | b).values()))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.08


def test_cws_limits_leave_out_only_what_is_never_least(spark, monkeypatch):
    """Limits leave out most rows and change no sample; where a limit leaves a sample open, all are worked out without any."""
    texts = [*some_texts(5, 60, 200, 150), None, "", "a", "b " * 3000, "one two", " \n"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = lambda df: {r.doc_id: (r.own, r.other, r.edited_sha256, r.n_chars) for r in df.collect()}
    plain = rows(cws._drawn(frame, 24, 2, None))
    limited = cws._drawn(frame, 24, 2, cws.SURE)
    assert limited.filter("not settled").isEmpty() and rows(limited) == plain and len(plain) == len(texts)
    assert not cws._drawn(frame, 24, 2, 0.5).filter("not settled").isEmpty()
    monkeypatch.setattr(cws, "SURE", 0.5)
    assert rows(cws.fingerprints(frame, 24, 2)) == plain
    terms = spark.range(400).selectExpr("0 block", "1 row", "xxhash64(id) term", "true in_own", "true in_other", "0L sha0", "0L sha1", "0L sha2", "0L sha3", "1L doc_id", "1L n_chars", "1L certain")
    each = terms.selectExpr("*", "0D ln_s", "28D / 400 below", "explode(sequence(0, 23)) k")
    assert cws.samples_of(each).count() < 400 * 24 / 5


def test_near_dedup_takes_links_of_the_covering_code(spark, monkeypatch):
    """Without any sampled anchors, texts within three bits are still found, and settled by their shingles."""
    import corpus_pipeline

    words = [f"w{i}" for i in range(1500)]
    texts = [" ".join(words), " ".join([*words[:-1], "other"]), " ".join(f"v{i}" for i in range(300)), "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    monkeypatch.setattr(similar, "families", lambda distinct, n: distinct.select(F.col("rep").alias("node"), F.col("rep").alias("root")).limit(0))
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [0, 2, 3]
