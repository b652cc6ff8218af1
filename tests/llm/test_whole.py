"""The whole job, where an earlier form did less of it."""

import numpy as np
from pyspark.sql import functions as F

from pagemill.llm import decontam, similar, tokenstore, wrapper


def test_no_partner_is_lost_in_a_crowd(spark):
    """Templated texts just below 0.8, as near in bits as the one true partner that each of them has."""
    rng = np.random.default_rng(11)
    words = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(4000)]
    base, rows = list(rng.choice(words, 400)), []
    for i in range(80):
        w = list(base)
        w[100:150] = rng.choice(words, 50)
        rows.append((i, " ".join(w)))
        w[300:334] = rng.choice(words, 34)
        rows.append((100 + i, " ".join(w)))
    sets = {i: set(similar.shingles(t).tolist()) for i, t in rows}
    alike = [(i, j) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert len(alike) == 80 and all(j == i + 100 for i, j in alike)
    got = {r.doc_id: r.component_id for r in similar.groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {i: i % 100 for i in sets}


def test_crowded_pairs_hold_all_alike(spark):
    rng = np.random.default_rng(12)
    words = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(2000)]
    base, rows = list(rng.choice(words, 120)), []
    for i in range(150):
        w = list(base[: int(rng.integers(90, 121))])
        for k in rng.integers(0, len(w), int(rng.integers(0, 5))):
            w[k] = str(rng.choice(words))
        rows.append((i, i, " ".join(w)))
    sets = {i: set(similar.shingles(t).tolist()) for i, _, t in rows}
    alike = {(j, i) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    got = {tuple(r) for r in similar.crowded_pairs(spark.createDataFrame(rows, "rep bigint, comp bigint, text string")).collect()}
    assert alike and alike <= got
    one = spark.createDataFrame(rows, "rep bigint, comp bigint, text string").withColumn("comp", F.lit(0))
    assert similar.crowded_pairs(one).isEmpty()


def test_prints_do_not_count_repeats(spark):
    rng = np.random.default_rng(13)
    single = " ".join("".join(rng.choice(list("abcdefghij"), 6)) for _ in range(200))
    line = "all rights reserved by the owner of this page"
    rows = [(i, f"{single} {' '.join([line] * n)}") for i, n in enumerate((100, 3))]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert len({tuple(r)[1:] for r in similar.prints(frame).collect()}) == 1
    assert {r.component_id for r in similar.groups(frame).collect()} == {0}


def test_near_dedup_of_repeated_and_null_ids(spark):
    import corpus_pipeline as C

    rows = [(7, "one text of its own"), (7, "quite another one under the id"), (7, "one text of its own"), (None, "no id but a copy"), (None, "no id but a copy"), (None, "one text of its own"), (3, "the last of them here")]
    frame = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = sorted((r.doc_id or 0, r.text) for r in C.near_dedup(spark, frame, "").collect())
    assert got == [(0, "no id but a copy"), (3, "the last of them here"), (7, "one text of its own"), (7, "quite another one under the id")]


def test_near_matches_do_not_need_the_replaced_word(spark):
    common = [f"c{i}" for i in range(10)]
    window = [*common[:5], "rare1", "rare2", "rare3", *common[5:]]
    edited = ["other" if w == "c4" else w for w in window]
    bench = spark.createDataFrame([("a", " ".join(window))], "item_id string, text string")
    rows = [(1, " ".join(edited)), (2, " ".join(common * 30)), (3, "rare1"), (4, "rare2 rare3"), (5, " ".join(window[5:]))]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    for segment_words in (1, 10**6):  # each document a segment of its own, or all in one
        found = decontam.search(decontam.build_index(frame, segment_words), decontam.Phrases([("a", " ".join(window))]))
        assert {r.doc_id: r.n_near for r in found.collect()} == {1: 1, 2: 0, 3: 0, 4: 0, 5: 1}
    assert {r.doc_id: r.n_hit for r in decontam.contamination(frame, bench).collect()} == {i: 0 for i in range(1, 6)}


def test_title_and_lead_are_in_the_main_text():
    page = lambda w, rest="": f"<html><body><div>Site name</div><div><article><h1>Title {w}</h1><p>Lead {w}</p><div class=body>{'<p>Long text ' * 40}{w}</div></article></div>{rest}</body></html>"
    path = wrapper.induce([page(w) for w in ("one", "two", "three")])
    got = wrapper.extract(page("four"), path).split("\n")
    assert got[:2] == ["Title four", "Lead four"] and len(got) == 42
    more = wrapper.extract(page("five", "<div><p>a block that the sampled pages do not have</p></div>"), path)
    assert "Lead five" in more and "a block that the sampled pages do not have" in more


def test_a_page_of_one_table_does_not_set_the_root():
    pages = [f"<html><body><div id=x><table><tr><td>{w}</td></tr></table></div></body></html>" for w in ("one", "two", "three")]
    other = "<html><body><div id=x><p>before</p><table><tr><td>cell</td></tr></table><p>after</p></div></body></html>"
    assert wrapper.extract(other, wrapper.induce(pages)) == "before\ncell\nafter"


def test_all_children_are_aligned():
    page = lambda w: wrapper.parse(f"<body>{'<p>same</p>' * 100}<p>{w}</p></body>")
    assert wrapper.tree_match(page("a"), page("b"))[0] == 103


def test_special_tokens_are_as_the_library_has_them(spark):
    from tokenizers import Tokenizer

    path = tokenstore.default_tokenizer()
    texts = ["one <|endoftext|> two", "<|endoftext|>", "plain words, and more."]
    want = [Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(b, "<u2").tolist() for b in tokenstore.Encoder(path).encode_all(texts)] == want
