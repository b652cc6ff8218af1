"""Operators against brute force, the libraries they agree with, exact round trips and held-out accuracy."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pagemill.llm import cws, decontam, pii, queries, rules, simhash, similar, spviterbi, tokenstore, toxicity
from pagemill.llm.common import connected_components, table

D = "/root/testdata/sf0.001"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{D}/documents.parquet").sort_values("doc_id")


def run(spark, name):
    return queries.QUERIES[name](spark, D).toPandas()


# personal data

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def plain_spans(text):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m.group())
            good = (lambda: True, lambda: all(int(x) <= 255 for x in m.group().split(".")), lambda: 16 <= len(digits) <= 19 and pii.luhn(digits), lambda: 8 <= len(digits) <= 15)[k]()
            out += [(k, m.start(), m.end())] if good else []
    return out


@given(st.text(alphabet="0125.@+- (a)%é\n", max_size=60))
@settings(max_examples=400, deadline=None)
def test_base_spans_equal_the_patterns(text):
    assert pii.base_spans(text) == plain_spans(text)


def test_pii_query(spark, docs):
    got = run(spark, "op1_pii").set_index("doc_id")
    for i, t in zip(docs.doc_id, docs.text):
        base = plain_spans(t)
        assert got.base_sha256[i] == hashlib.sha256(pii.digest(base).encode()).hexdigest()
        assert [got[f"n_{k}"][i] for k in pii.KINDS] == [sum(s[0] == j for s in base) for j in range(4)]
        assert set(pii.digest(base).split(",")) <= set(got.spans[i].split(",")) | {""}


def test_field_adds_what_patterns_miss_and_masks():
    train = [f"word {w} call +1 (555) 12{i}-4567 now or a{i}@b{i}.com then 411111111111111{i % 10} and 10.0.{i}.1 ok" for i, w in enumerate("abcdefghij" * 20)]
    model = pii.fit(train)
    text = "Elle +1 (569) 555-6633 4795326016703902 done"  # the phone pattern runs into the card, and both are dropped
    found = pii.find([text], model)[0]
    assert not any(s[3] for s in found) and "phone" in {pii.KINDS[s[0]] for s in found}
    assert pii.masked("a b@c.de x", [(0, 2, 8, True)]) == "a <EMAIL> x"
    assert pii.find(["only words here"], model) == [[]]


def test_messages_equal_enumeration():
    rng = np.random.default_rng(3)
    k = len(pii.KINDS) + 1
    model = pii.Field(rng.normal(size=(len(pii.FEATURES), k)), rng.normal(size=(k, k)), 1.5 * np.eye(k))
    g = pii.graph_of(["12 34 56 then 12"])
    g.skip = g.skip[:0]  # without the skip link it is a chain, where messages are exact
    p = model.marginals(g, rounds=60)
    u = g.x @ model.unary
    n, total = len(u), np.zeros_like(u)
    for code in np.ndindex(*[k] * n):
        w = np.exp(sum(u[i, c] for i, c in enumerate(code)) + sum(model.chain[code[a], code[b]] for a, b in g.chain))
        for i, c in enumerate(code):
            total[i, c] += w
    assert np.allclose(p, total / total.sum(1, keepdims=True), atol=1e-6)


# classifiers


def test_toxicity_learns_words_and_stems():
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(300)]
    texts, y = [], []
    for i in range(600):
        w = list(rng.choice(words, 40))
        if i % 4 == 0:
            w[int(rng.integers(40))] = "zorg" + str(rng.choice(["a", "chen", "ito", "ung"]))
        texts.append(" ".join(w))
        y.append(int(i % 4 == 0))
    net = toxicity.train(texts[:450], y[:450], epochs=8)
    s = toxicity.Scorer(net).scores(texts[450:])
    assert ((s >= 0.3) == np.array(y[450:], bool)).mean() > 0.95
    assert toxicity.Scorer(net).scores([texts[0], texts[0], None, ""]).round(12).tolist()[0] == toxicity.Scorer(net).scores([texts[0]]).round(12)[0]


def test_rules_learn_and_compile(spark):
    rng = np.random.default_rng(2)
    x = rng.random((2000, len(rules.NAMES)))
    y = ((x[:, 2] > 0.5) & (x[:, 4] <= 0.7)).astype(float)
    model = rules.train(x, y)
    assert ((model.predict(x) >= 0.5) == y).mean() > 0.97
    frame = spark.createDataFrame([tuple(map(float, r)) for r in x[:50]], ", ".join(f"`{n}` double" for n in rules.NAMES))
    got = [r.s for r in frame.select(model.column([F.col(n) for n in rules.NAMES]).alias("s")).collect()]
    assert np.allclose(got, model.predict(x[:50]))
    assert list(rules.statistics(F.lit("")).keys()) == list(rules.NAMES)


def test_language_query(spark, docs):
    got = run(spark, "op4_language").merge(docs, on="doc_id")
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    assert (got.lang_pred == got.lang)[got.held_out].mean() > 0.85


# stores and fingerprints


def test_token_store(spark, docs):
    got = run(spark, "op3_token_store").set_index("doc_id")
    whole = Tokenizer.from_file(tokenstore.default_tokenizer())
    start = 0
    for i, t in zip(docs.doc_id, docs.text):
        ids = [*whole.encode(t, add_special_tokens=False).ids, 0]
        assert tuple(got.loc[i]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_store_keeps_chunks_once_and_finds_damage(spark, tmp_path):
    d = spark.createDataFrame([(i, "same words " * 400) for i in range(20)] + [(99, "other")], "doc_id bigint, text string")
    store = tokenstore.write(d, str(tmp_path / "s"), blocks=3)
    chunks = store.table(spark, "chunks")
    assert chunks.count() == chunks.select("hash").distinct().count() < 12
    ids = {r.doc_id: r.ids for r in tokenstore.ids_of(store, spark).collect()}
    assert ids[0] == ids[19] and tokenstore.documents(store, spark).count() == 21
    broken = chunks.withColumn("ids", F.when(F.col("hash") == chunks.first().hash, F.lit(b"\x01\x00")).otherwise(F.col("ids")))
    broken.write.parquet(str(tmp_path / "b" / "chunks"))
    for t in ("recipes", "manifest", "root"):
        store.table(spark, t).write.parquet(str(tmp_path / "b" / t))
    with pytest.raises(Exception, match="content of its address"):
        tokenstore.documents(tokenstore.Store(str(tmp_path / "b")), spark).collect()
    for t in ("chunks", "recipes", "root"):
        store.table(spark, t).write.parquet(str(tmp_path / "c" / t))
    store.table(spark, "manifest").withColumn("n_tokens", F.col("n_tokens") + 1).write.parquet(str(tmp_path / "c" / "manifest"))
    with pytest.raises(ValueError, match="root over all blocks"):
        tokenstore.documents(tokenstore.Store(str(tmp_path / "c")), spark)


@given(st.lists(st.integers(0, 3), max_size=3000), st.lists(st.binary(max_size=40), min_size=1, max_size=6))
@settings(max_examples=60, deadline=None)
def test_cuts_and_moved_sums(ids, parts):
    a = np.array(ids, np.uint16)
    ends = tokenstore.cuts(a)
    assert (ends[-1:] or [0])[0] == len(a) and ends == sorted(set(ends)) and all(e - s <= tokenstore.MOST for s, e in zip([0, *ends], ends))
    after = np.array([sum(map(len, parts[i + 1 :])) for i in range(len(parts))])
    moved = tokenstore.crc_moved(np.array([zlib.crc32(p) for p in parts], np.uint64), after)
    assert int(np.bitwise_xor.reduce(moved)) == zlib.crc32(b"".join(parts))


def test_consistent_sampling(spark, docs):
    got = run(spark, "op5_fingerprints").set_index("doc_id")
    texts = docs.text.tolist()
    jac = lambda a, b: (lambda x, y: sum((x & y).values()) / max(1, sum((x | y).values())))(Counter(a.split()), Counter(b.split()))
    errors = []
    for n, (i, t) in enumerate(zip(docs.doc_id, texts)):
        nxt = texts[(n + 1) % len(texts)]
        cut = len(t) // 4
        edited = t[: len(t) - cut] + nxt[:cut]
        assert got.edited_sha256[i] == hashlib.sha256(edited.encode()).hexdigest() and got.n_chars[i] == len(t)
        errors.append((got.near_edited[i] - jac(t, edited), got.near_next[i] - jac(t, nxt)))
    assert abs(np.mean(errors, axis=0)).max() < 0.04 and np.std(errors, axis=0).max() < 0.2
    same = docs.groupby("text").doc_id.agg(list)
    assert all(len(set(got.fingerprint[ids])) == 1 for ids in same)


# near-duplicates


def plain_print(text, k=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOW))
    if not w:
        return 0
    n = max(1, len(w) - k + 1)
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(n)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > n)


def components_of(values):
    ids = list(values)
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and (values[a] ^ values[b]).bit_count() <= 3:
                p, q = sorted((find(a), find(b)))
                up[q] = p
    return {i: find(i) for i in ids}


def test_simhash_query(spark, docs):
    got = run(spark, "op6_simhash").set_index("doc_id")
    prints = {i: plain_print(t) for i, t in zip(docs.doc_id, docs.text)}
    assert all(got.fingerprint[i] == f"{v:016x}" for i, v in prints.items())
    assert dict(got.component_id) == components_of(prints)


@pytest.mark.parametrize("limit", [4096, 5])
def test_links_of_dense_groups(spark, limit):
    rng = np.random.default_rng(4)
    values = {}
    for centre in rng.integers(0, 2**63, 6):
        for _ in range(40):
            v = int(centre)
            for b in rng.integers(0, 64, int(rng.integers(0, 5))):
                v ^= 1 << int(b)
            values[len(values)] = v
    signed = [(i, v - (1 << 64) if v >= 1 << 63 else v) for i, v in values.items()]
    frame = spark.createDataFrame([(v,) for _, v in signed], "fp bigint").distinct()
    roots = {r.node: r.root for r in connected_components(simhash.links(frame, limit)).collect()}
    want, groups = components_of(values), defaultdict(set)
    for i, v in signed:
        groups[roots.get(v, v)].add(i)
    wanted = defaultdict(set)
    for i, r in want.items():
        wanted[r].add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_each_near_pair_meets_at_a_home():
    rng = np.random.default_rng(6)
    fp = rng.integers(0, 2**63, 300).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    other = fp.copy()
    for _ in range(3):
        other ^= np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)
    i, key, home = simhash.anchors_of(fp)
    j, key2, _ = simhash.anchors_of(other)
    homes, all_ = defaultdict(set), defaultdict(set)
    for a, k in zip(i[home], key[home]):
        homes[a].add(k)
    for a, k in zip(j, key2):
        all_[a].add(k)
    assert all(homes[n] & all_[n] for n in range(300))


@pytest.mark.parametrize("crowd", [3, 700])
def test_similar_groups(spark, crowd):
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(500)]
    base = list(rng.choice(words, 300))
    rows = []
    for i in range(crowd):
        w = list(base)
        for k in rng.integers(0, 300, 3):
            w[k] = str(rng.choice(words))
        rows.append((i, " ".join(w)))
    rows += [(10_000 + i, " ".join(rng.choice(words, 300))) for i in range(30)] + [(20_000, None), (20_001, ""), (None, "x")]
    got = {r.doc_id: r.component_id for r in similar.groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert {got[i] for i in range(crowd)} == {0} and all(got[10_000 + i] == 10_000 + i for i in range(30)) and got[20_001] == 20_000 and None not in got


# decontamination


def test_contamination_query(spark, docs):
    got = run(spark, "op8_contamination").set_index("doc_id")
    word, windows = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), defaultdict(set)
    bench = pd.read_parquet(f"{D}/benchmark.parquet")
    for i, t in zip(bench.item_id, bench.text):
        w = word.findall(t.translate(LOW))
        for k in range(max(1, len(w) - 12)):
            windows[tuple(w[k : k + 13])].add(str(i))
    for i, t in zip(docs.doc_id, docs.text):
        w = word.findall(t.translate(LOW))
        hit, items = np.zeros(len(w), bool), set()
        for k in range(len(w)):
            if found := windows.get(tuple(w[k : k + 13])):
                hit[k : k + 13] = True
                items |= found
        n = int(hit.sum())
        want = (len(w), n, len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), n > 0 and 20 * n >= len(w))
        assert tuple(got.loc[i])[:5] == want
    assert list(got.columns)[5:] == ["n_near"]
    lists = [word.findall(t.translate(LOW)) for t in docs.text]
    counts = Counter(w for ws in lists for w in ws)
    places = [defaultdict(list) for _ in lists]
    for at, ws in zip(places, lists):
        for p, w in enumerate(ws):
            at[w].append(p)
    near = [0] * len(lists)
    for phrase in (p for p in windows if len(p) >= 3):
        a, b, c = sorted(range(len(phrase)), key=lambda j: counts[phrase[j]])[:3]
        for d, at in enumerate(places):
            for p in at.get(phrase[a], ()):
                near[d] += all(any(abs(q - p - (j - a)) <= 3 for q in at.get(phrase[j], ())) for j in (b, c))
    assert got.n_near[docs.doc_id].tolist() == near and sum(near) > 50


def test_short_and_near_phrases(spark):
    docs = spark.createDataFrame([(1, "red fox. Jumps high"), (2, "red the fox jumps"), (3, "fox"), (4, None)], "doc_id bigint, text string")
    bench = spark.createDataFrame([("a", "Red fox jumps"), ("b", "fox"), ("c", None), ("d", "!!")], "item_id string, text string")
    got = {r.doc_id: r for r in decontam.contamination(docs, bench).collect()}
    assert (got[1].n_hit, got[1].items) == (3, ["a", "b"]) and (got[2].n_hit, got[2].items, got[2].n_near) == (1, ["b"], 1) and got[3].contaminated and not got[4].contaminated


# sentencepiece


@given(st.text(alphabet="ab thé\n▁ 漢😀ing", max_size=80))
@settings(max_examples=150, deadline=None)
def test_viterbi_is_the_best_path(text):
    e = spviterbi.encoder(spviterbi.default_model())
    marked = spviterbi.MARK + text.replace(" ", spviterbi.MARK) if text else ""
    best, back = [0.0] + [-1e300] * len(marked), [None] * (len(marked) + 1)
    for j in range(1, len(marked) + 1):
        for i in range(max(0, j - e.v.longest), j):
            got = e.v.pieces.get(marked[i:j])
            if got and best[i] + got[1] > best[j]:
                best[j], back[j] = best[i] + got[1], (i, [got[0]])
        if marked[j - 1] not in e.v.pieces and best[j - 1] + e.v.unk_score > best[j]:
            best[j], back[j] = best[j - 1] + e.v.unk_score, (j - 1, e.v.unknown(marked[j - 1]))
    want, j = [], len(marked)
    while j:
        want = back[j][1] + want
        j = back[j][0]
    assert np.frombuffer(e.encode(text), "<u2").tolist() == want
    assert [i for part in spviterbi.stream([marked[k : k + 7] for k in range(0, len(marked), 7)], e.v) for i in part] == want
    if spviterbi.MARK not in text:
        assert e.decode(e.encode(text)) == text


def test_stream_holds_a_window_only():
    v = spviterbi.vocabulary(spviterbi.default_model())
    sizes = [len(part) for part in spviterbi.stream(("▁the▁cat" for _ in range(2000)), v)]
    assert max(sizes) < 100 and sum(sizes) > 2000


# the pipeline


def test_pipeline_is_its_stages(spark, docs):
    import corpus_pipeline as C

    d = table(spark, D, "documents")
    kept = [r.asDict() for r in d.collect()]
    for name, stage in C.STAGES[:4]:
        d = stage(spark, d, D)
        assert d.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        rows = {r.doc_id: r for r in d.collect()}
        before = {r["doc_id"]: r for r in kept}
        if name == "near_dedup":
            sets = {i: set(similar.shingles(r["text"]).tolist()) for i, r in before.items()}
            alike = {i: [j for j in sets if j != i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])] for i in sets}
            gone = set(before) - set(rows)
            assert gone and all(alike[i] for i in gone)  # clean documents stay
            assert all(min(alike[i], default=i) > i or i in gone for i in sets if any(before[j]["text"] == before[i]["text"] for j in alike[i]))
            assert len(gone) >= 0.9 * sum(min(alike[i], default=i) < i for i in sets)
        if name == "personal_data":
            assert set(rows) == set(before) and all(not plain_spans(r.text) and r.n_chars == len(r.text) for r in rows.values())
        else:
            assert set(rows) <= set(before) and all(rows[i].text == before[i]["text"] for i in rows)
        kept = [r.asDict() for r in rows.values()]
    out = {r.doc_id: r for r in C.run(spark, D).collect()}
    assert set(out) == {r["doc_id"] for r in kept} and all(r.decoded for r in out.values())
    e = spviterbi.encoder(spviterbi.default_model())
    assert all(out[r["doc_id"]].ids == np.frombuffer(e.encode(r["text"]), "<u2").tolist() for r in kept)
