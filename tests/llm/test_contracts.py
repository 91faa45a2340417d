"""Each query on the smallest tables and on edge cases, against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import types as T

from quillspark.llm import catalogue
from tests.llm import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def edge_texts():
    r = random.Random(3)
    vocab = [f"w{i}" for i in range(300)]
    base = [" ".join(r.choices(vocab, k=120)) for _ in range(12)]
    out = [None, "", " \t\n", "one", "One two", "one two", "a a a a a a a a a a a a a a a a", "ÀB c d e", "x" * 700_000 + " y", "<|endoftext|>", "a <|endoftext|> b  <|endoftext|>c<|endoftext|>\n\n<|endoftext |>", *base, *base[:3]]
    for t in base:  # near copies
        for k in (1, 2, 3, 4, 8):
            w = t.split()
            for _ in range(k):
                w[r.randrange(len(w))] = r.choice(vocab)
            out.append(" ".join(w))
    passage = " ".join(r.choices(vocab, k=60))
    out += [f"{b[:200]} {passage} {b[300:]}" for b in base[:6]]
    out += ["r " * 40, "x " + "r " * 25, "p q " * 30, "z " + "q p " * 22, "p q r " * 12, f"r r {passage} p q p q", f"q {passage} r r r"]  # runs and periods
    out += ["long " * 3 + " ".join(r.choices(vocab, k=60_000)), "\n".join(["line one", "line one", "", "x", " x", "x"])]
    return [(i, t, None if i % 7 == 0 else f"s{i % 3}") for i, t in enumerate(out)]


SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType())])


@pytest.fixture(scope="module", params=["given", "edges", "empty"])
def case(request, spark, docs):
    rows = {"given": docs, "edges": edge_texts(), "empty": []}[request.param]
    return rows, spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'en' lang", "1L n_chars", "0 node", "0 comp", "0 a", "0 key").repartition(5)


def got(df, *cols):
    return {r.doc_id: tuple(r[c] for c in cols) for r in df.collect()}


def test_near_duplicates(case):
    from quillspark.llm.op3_minhash import near_duplicates

    rows, df = case
    assert got(near_duplicates(df), "n_shingles", "component_id", "kept") == brute.near([r[:2] for r in rows])


def test_repeats(case):
    from quillspark.llm.op9_repeats import dedup, without_repeats

    rows, df = case
    want = brute.substring([r[:2] for r in rows])
    assert got(dedup(df), "n_words", "n_removed", "kept_sha256") == want
    out = without_repeats(df).collect()
    assert {r.doc_id: (r.n_removed, len(brute.words(r.text))) for r in out} == {d: (k, n - k) for d, (n, k, _) in want.items()}
    given = {d: t for d, t, _ in rows}
    assert all(r.text == given[r.doc_id] for r in out if not r.n_removed)


def test_repeats_of_frequent_passages(spark, monkeypatch):
    from quillspark.llm import store
    from quillspark.llm.op9_repeats import dedup

    monkeypatch.setattr(store, "SAMPLED", 1)
    monkeypatch.setattr(store, "FREQUENT", 5)
    r = random.Random(4)
    words = lambda n: " ".join(f"u{r.randrange(10**6)}" for _ in range(n))
    common, rare = words(40), words(30)
    rows = [(i, f"{words(9)} {common} {words(7)}", None) for i in range(40)] + [(50 + i, f"{words(20)} {rare if i < 3 else ''} {common[:200]}", None) for i in range(6)]
    assert got(dedup(spark.createDataFrame(rows, SCHEMA)), "n_words", "n_removed", "kept_sha256") == brute.substring([x[:2] for x in rows])


def test_language_model(case):
    from quillspark.llm.op10_brown import score

    rows, df = case
    out = score(df).collect()
    want = brute.base_scores([r[:2] for r in rows])
    assert {r.doc_id: (r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in out} == {d: v[:4] for d, v in want.items()}
    assert all(r.base_score == pytest.approx(want[r.doc_id][4], rel=1e-9) and r.score < 0 for r in out)


def test_language_model_beats_base(spark):
    out = catalogue.QUERIES["op10_brown_lm"](spark, "/root/testdata/sf0.01").where("held_out")
    r = out.selectExpr("sum(score) / sum(n_tokens) s", "sum(base_score) / sum(n_tokens) b").first()
    assert r.s > r.b + 0.1, r


def test_rare_words_of_one_ending_have_classes(spark, monkeypatch):
    from quillspark.llm import op10_brown

    r = random.Random(5)
    sides = [[f"{s}{i}xy" for i in range(400)] for s in "ab"]  # each rarer than 1 in 256
    rows = [(d, " ".join(r.choice(sides[k % 2]) for k in range(60)), None) for d in range(600)]
    df, found = spark.createDataFrame(rows, SCHEMA), []
    for block in (8 << 20, 40_000):  # every word in one block, and shared between blocks
        monkeypatch.setattr(op10_brown, "BLOCK", block)
        found.append(got(op10_brown.score(df).where("held_out"), "score", "base_score"))
    a, b = (np.array([x[d] for d in sorted(x)]) for x in found)
    assert a[:, 0].sum() > a[:, 1].sum() + 0.15 * 61 * len(a)
    assert b == pytest.approx(a, rel=1e-9)


def test_pipeline(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    a = P.quality_stage(spark, docs, SF)
    b = P.near_duplicate_stage(spark, a, SF)
    rows = [(r.doc_id, r.text) for r in b.collect()]
    c = P.substring_stage(spark, b, SF)
    want = brute.substring(rows)
    left = {r.doc_id: len(brute.words(r.text)) for r in c.collect()}
    assert left == {d: n - k for d, (n, k, _) in want.items() if n > k or not n}
    d = P.mixing_stage(spark, c, SF)
    assert c.columns == d.columns == docs.columns
    times = {}
    for r in d.collect():
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    assert set(times) <= set(left) and max(times.values()) <= 3
    assert P.run(spark, SF).count() > 0


def test_rules(spark, case):
    from quillspark.llm.op5_rules import rules

    rows, df = case
    labels = spark.createDataFrame([(r[0], 1, 0) for r in rows[::2]] + [(None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    out = rules(df, labels).collect()
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in out} == {d: brute.rules(t) for d, t, _ in rows}
    for r in out:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_mix(case):
    from quillspark.llm.op6_mix import mix

    rows, df = case
    out = mix(df).collect()
    assert sorted(r.doc_id for r in out) == sorted(r[0] for r in rows)
    size = {d: len(brute.words(t)) for d, t, _ in rows}
    source = {d: s for d, _, s in rows}
    total, by = sum(size.values()), {}
    for r in out:
        assert r.size == size[r.doc_id] and r.taken <= 3 * r.size and (not r.size or r.taken % r.size == 0)
        by.setdefault(source[r.doc_id], []).append(r)
    for rs in by.values():
        assert sum(r.size for r in rs) == rs[0].source_size
        assert abs(sum(r.taken for r in rs) - rs[0].target) <= max(r.size for r in rs) + 1
    assert not out or abs(sum(rs[0].target for rs in by.values()) - total) < 1
    assert {r.doc_id: r.taken for r in mix(df.repartition(3)).collect()} == {r.doc_id: r.taken for r in out}


def test_pack(case):
    import zlib

    import public_tokenizers
    from tokenizers import Tokenizer

    from quillspark.llm.op7_pack import pack

    rows, df = case
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {d: [*t.encode(x or "", add_special_tokens=False).ids, 0] for d, x, _ in rows}
    out = pack(df).collect()
    by_doc, by_seq = {}, {}
    for r in out:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(ids)
    for d, rs in by_doc.items():
        rs.sort(key=lambda r: r.piece)
        assert [r.piece for r in rs] == list(range(len(rs))) and sum(r.length for r in rs) == len(ids[d])
        assert len(rs) == 1 or all(r.length == 2048 for r in rs[1:])
        for r in rs:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[d][r.start : r.start + r.length], "<u4").tobytes())
    for rs in by_seq.values():
        rs.sort(key=lambda r: r.offset)
        at = 0
        for r in rs:
            assert r.offset == at
            at += r.length
        assert at <= 2048
    lower = -(-sum(map(len, ids.values())) // 2048)
    assert len(by_seq) <= lower * 1.15 + 2


def test_counts(case):
    from quillspark.llm import tokens
    from quillspark.llm.op8_count import counts, script

    rows, df = case
    enc = tokens.encoder(tokens.default_ranks()).encode
    want = {}
    for d, t, _ in rows:
        t = t or ""
        before = len(enc(t))
        for a, b, new in script(t):
            t = t[:a] + new + t[b:]
        want[d] = (before, len(enc(t)))
    assert got(counts(df), "n_tokens", "n_tokens_edited") == want


def test_tree_of_edits():
    from quillspark.llm import tokens
    from quillspark.llm.op8_count import Tree

    enc, r = tokens.encoder(tokens.default_ranks()), random.Random(5)
    parts = ["word", " ", "  ", "\n", "don't", "42", "é", "x y z", "", " ", "  tail "]
    for n in (0, 1, 40, 900):
        text = " ".join(r.choice(parts) for _ in range(n))
        tree = Tree.of(text, enc)
        for _ in range(60):
            a = r.randint(0, len(text))
            b = min(len(text), a + r.choice([0, 0, 1, 5, 300]))
            text, _ = tree.edit(text, a, b, "".join(r.choices(parts, k=r.randint(0, 6))))
            assert tree.tokens == len(enc.encode(text)) and tree.leaves()[1].sum() == len(text)


def test_edits_at_one_place_stay_local():
    from quillspark.llm import tokens
    from quillspark.llm.op8_count import Tree

    enc = tokens.encoder(tokens.default_ranks())
    text = "one two three " * 3000
    tree, again = Tree.of(text, enc), []
    for _ in range(60):
        text, n = tree.edit(text, 20_000, 20_000, " put in here" * 50)
        again.append(n)
    assert tree.tokens == len(enc.encode(text))
    assert max(again) < 4 * again[0], again


def test_quality(spark, case):
    from quillspark.llm.op1_quality import quality

    rows, df = case
    labels = spark.createDataFrame([(r[0], int(r[0] % 5 > 0), 0) for r in rows[::2]] + [(None, 1, 1)], "doc_id long, quality int, toxic int")
    out = quality(df, labels).collect()
    assert sorted(r.doc_id for r in out) == sorted(r[0] for r in rows)
    assert all(r.kept == (r.p_quality >= 0.5 and r.toxic_logit <= 0) for r in out)
    assert all(r.kept for r in quality(df, labels.limit(0)).collect())


def test_quality_shrinks_sites(spark):
    """Site rates, strengths and posteriors against plain Python over the same logits."""
    from collections import defaultdict

    from quillspark.llm.op1_quality import quality

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    site = {r.doc_id: (r.source, r.lang) for r in docs.collect()}
    out = quality(docs, spark.read.parquet("/root/testdata/sf0.01/labels.parquet")).collect()
    paths, hosts = defaultdict(lambda: [0, 0.0]), defaultdict(lambda: [0, 0.0])
    for r in out:
        for group, key in ((paths, site[r.doc_id]), (hosts, site[r.doc_id][0])):
            group[key][0] += 1
            group[key][1] += 1 / (1 + np.exp(-r.quality_logit))
    total = sum(n for n, _ in hosts.values())
    rate = sum(s for _, s in hosts.values()) / total

    def strength(groups):
        between = sum(n * (s / n) ** 2 for n, s in groups.values()) / total - rate**2 - len(groups) * rate * (1 - rate) / total
        return float(np.clip(rate * (1 - rate) / between - 1, 1, 1e6)) if between > 1e-9 else 1e6

    a, b = strength(hosts), strength(paths)
    for r in out:
        (n, s), (hn, hs) = paths[site[r.doc_id]], hosts[site[r.doc_id][0]]
        q = (s + b * (hs + a * rate) / (hn + a)) / (n + b)
        assert r.site_rate == pytest.approx(q, rel=1e-6)
        z = r.quality_logit + np.log(q / (1 - q)) - np.log(rate / (1 - rate))
        assert r.p_quality == pytest.approx(1 / (1 + np.exp(-z)), rel=1e-6)


def test_quality_takes_the_worst_of_repeated_labels(spark):
    from quillspark.llm.op1_quality import quality

    docs = spark.createDataFrame([(i, ("good words here " if i % 2 else "bad stuff there ") * 9, "s", "en") for i in range(80)], "doc_id long, text string, source string, lang string")
    plain = [(i, i % 2, 0) for i in range(80)]
    one = quality(docs, spark.createDataFrame(plain, "doc_id long, quality int, toxic int"))
    two = quality(docs, spark.createDataFrame(plain + [(i, 1, 0) for i in range(0, 80, 2)], "doc_id long, quality int, toxic int"))
    assert got(one, "quality_logit", "kept") == got(two, "quality_logit", "kept")
    assert {r.doc_id % 2 for r in one.where("kept").collect()} == {1}


def test_log_likelihood_ratio(spark):
    """llr and verdicts against plain counts of words and pairs in hashed buckets."""
    import math
    from collections import Counter

    import pyarrow as pa

    from quillspark.llm import op5_rules as R
    from quillspark.llm import words as K

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    good = [d for d, _ in docs[::3]]
    labels = spark.createDataFrame([(d, 1, 0) for d in good], "doc_id long, quality int, toxic int")
    df = spark.createDataFrame([(d, t, None) for d, t in docs], SCHEMA)
    h = {r.doc_id: r.h for r in labels.selectExpr("doc_id", "xxhash64(doc_id) h").collect()}
    out = {r.doc_id: r for r in R.rules(df, labels).collect()}

    def grams(t):
        w = brute.words((t or "").translate(brute.LOW))
        b = K.split(pa.array([" ".join(w)]))
        x = b.hashes()
        two, _ = K.grams(x, b.at, 2)
        return [int(v) >> 46 for v in x.tolist() + two.tolist()]

    raw, target = Counter(), Counter()
    for d, t in docs:
        raw.update(grams(t))
        if d in h and h[d] % 2 == 0:
            target.update(grams(t))
    n_raw, n_target = sum(raw.values()) + R.BUCKETS, sum(target.values()) + R.BUCKETS
    ratio = lambda g: math.log((target[g] + 1) / n_target) - math.log((raw[g] + 1) / n_raw)
    llr = {d: (lambda g: sum(map(ratio, g)) / len(g) if g else 0.0)(grams(t)) for d, t in docs}
    assert all(out[d].llr == pytest.approx(v, abs=1e-5) for d, v in llr.items())
    held = [llr[d] for d in good if h[d] % 2 and out[d].n_words >= 10]
    edge = sum(held) / len(held) - R.MARGIN
    assert all(out[d].kept == (not out[d].base_failed and v >= edge) for d, v in llr.items() if abs(v - edge) > 1e-4)


def test_quality_held_out(spark):
    """Fitted on half of the labels, the other half's toxic and junk documents are found and clean ones kept."""
    from quillspark.llm.op1_quality import quality

    at = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{at}/labels.parquet")
    out = quality(spark.read.parquet(f"{at}/documents.parquet"), labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1"), "doc_id")
    r = out.selectExpr("avg(if(quality = 1 and toxic = 0, int(kept), null)) good", "avg(if(toxic = 1, int(kept), null)) toxic", "avg(if(quality = 0, int(kept), null)) low").first()
    assert r.good > 0.95 and r.toxic < 0.15 and r.low < 0.25, r


def pages_cases():
    return [(1, "u", "<p>é</p>"), (2, "u", "<p>é</p>"), (3, None, None), (4, "", ""), (9, "a b\n", "x"), (5, "v", "WARC/1.1\r\n\r\n\r\n\r\nx"), (7, "v", "x"), (8, "w", "y" * 300_000)]


def test_pipeline_null_and_repeated_ids(spark):
    from collections import Counter

    import corpus_pipeline as P

    sf = "/root/testdata/sf0.01"  # the smallest that has rejected texts

    def count(df):
        return Counter((r.doc_id, r.text) for r in df.collect())

    docs = spark.read.parquet(f"{sf}/documents.parquet").select(P.COLUMNS)
    kept = {r.doc_id for r in P.quality_stage(spark, docs, sf).collect()}
    rows = docs.collect()
    good, bad = [r for r in rows if r.doc_id in kept][:3], [r for r in rows if r.doc_id not in kept][:3]
    assert len(good) == len(bad) == 3
    r = random.Random(9)
    fresh = [" ".join(r.choice("abcdefgh") * 3 + str(r.randrange(10**6)) for _ in range(80)) for _ in range(4)]
    make = lambda rows: spark.createDataFrame(rows, docs.schema)
    row = lambda d, t: (d, t, "en", "s", len(t))
    # a rejected text beside a kept one of the same id, each also without id
    mixed = [(d, *x[1:]) for g, b in zip(good, bad) for d in (None, 10**6 + g.doc_id) for x in (g, b)]
    out = count(P.quality_stage(spark, docs.unionByName(make(mixed)), sf))
    for g, b in zip(good, bad):
        for d in (None, 10**6 + g.doc_id):
            assert out[d, g.text] == 1 and out[d, b.text] == 0
    f = make([row(None, fresh[0]), row(None, fresh[1]), row(5, fresh[2]), row(5, fresh[2]), row(5, fresh[3]), row(6, fresh[2]), row(None, fresh[3])]).repartition(3)
    out = P.near_duplicate_stage(spark, f, sf)
    assert count(out) == {(None, fresh[0]): 1, (None, fresh[1]): 1, **{k: n for k, n in count(out).items() if k[1] in fresh[2:]}}
    assert Counter(t for _, t in count(out).elements()) == dict.fromkeys(fresh, 1)
    left = P.substring_stage(spark, out, sf)
    assert count(left) == count(out)
    assert set(count(P.mixing_stage(spark, left, sf))) == set(count(left))


def test_pipeline_stages_on_no_rows(spark):
    import corpus_pipeline as P

    none = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, none, SF).count() == 0


@pytest.mark.parametrize("rows", [pages_cases(), []], ids=["edges", "empty"])
@pytest.mark.parametrize("least", [0, 2])
def test_warc(spark, tmp_path, rows, least):
    from quillspark.llm import op2_warc as W

    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    W.write(df, f"file://{tmp_path}/a", least)
    back = W.reconstruct(W.read(spark, f"file://{tmp_path}/a")).collect()
    want = brute.warc([(p, h) for p, _, h in rows], least)
    assert {r.page_id: (len(r.payload), r.digest, r.record_type, r.refers_to) for r in back} == want
    assert {r.page_id: bytes(r.payload).decode() for r in back} == {p: h or "" for p, _, h in rows}
    assert all(r.header.startswith(b"WARC/1.1\r\n") and r.header.endswith(b"\r\n\r\n") for r in back)


def test_warc_stores_repeated_rows_once(spark, tmp_path):
    from quillspark.llm import op2_warc as W

    rows = [(1, "u", "same"), (1, "u", "same"), (1, "v", "same"), (1, None, "same"), (None, "u", "same"), (0, "u", "same"), (None, "w", "other"), (None, None, "other")]
    W.write(spark.createDataFrame(rows, "page_id long, url string, html string"), f"file://{tmp_path}/a")
    store = W.read(spark, f"file://{tmp_path}/a")
    assert sorted(bytes(r.payload) for r in store.where("payload is not null").collect()) == [b"other", b"same"]
    back = W.reconstruct(store).collect()
    assert sorted((str(r.page_id), bytes(r.payload).decode()) for r in back) == sorted((str(p), h) for p, _, h in rows)
    assert all(r.refers_to == 1 for r in back if r.record_type == "revisit" and bytes(r.payload) == b"same")


def test_warc_refuses_changed_payloads(spark, tmp_path):
    from quillspark.llm import op2_warc as W

    W.write(spark.createDataFrame([(1, "u", "payload")], "page_id long, url string, html string"), f"file://{tmp_path}/a")
    at = next((tmp_path / "a").glob("*.gz"))
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "x.warc").write_bytes(W.unzipped(at.read_bytes()).replace(b"payload\r", b"paylaod\r"))
    with pytest.raises(Exception, match="digests"):
        W.read(spark, f"file://{tmp_path}/b").collect()


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_against_sql(spark, name):
    from tests.oracle import compare

    got_rows, want = compare(spark, catalogue.QUERIES[name], catalogue.ORACLES[name], SF)
    assert got_rows == want


def test_equal_windows_are_represented_alike():
    import pyarrow as pa

    from quillspark.llm import op9_repeats as R
    from quillspark.llm import words as K

    r = random.Random(1)
    for size in (2, 2, 3, 5, 5, 30, 400):
        vocab = [f"w{i}" for i in range(size)]
        passages = [[r.choice(vocab) for _ in range(r.choice([13, 14, 20, 60]))] for _ in range(6)]
        texts = [" ".join(w for _ in range(r.randint(1, 4)) for w in [*(r.choice(vocab) for _ in range(r.randint(0, 9))), *r.choice(passages)]) for _ in range(40)]
        b = K.split(pa.array(texts))
        h, seen = b.hashes(), {}
        for p, sym in zip(*(x.tolist() for x in R.symbols(h, b.at))):
            assert seen.setdefault(tuple(h[p : p + 13].tolist()), sym) == sym


def test_near_duplicates_of_shared_ids_and_large_buckets(spark, monkeypatch):
    from quillspark.llm import op3_minhash as M

    monkeypatch.setattr(M, "TILE_TEXTS", 8)
    r = random.Random(7)
    vocab = [f"v{i}" for i in range(500)]
    base = r.choices(vocab, k=150)
    rows = []
    for i in range(120):  # a large group whose members are similar to some others only
        w = list(base)
        for k in range(r.randint(0, 7)):
            w[r.randrange(150)] = r.choice(vocab)
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame([(d, t, None) for d, t in rows], SCHEMA)
    assert got(M.near_duplicates(df), "n_shingles", "component_id", "kept") == brute.near(rows)
    one, two = (" ".join(r.choices(vocab, k=80)) for _ in range(2))
    rows = [(5, one), (5, two), (5, one), (7, two), (9, one), (3, "a b c d"), (3, "e f g h"), (4, "e f g h"), (1, "x y z")]
    out = M.near_duplicates(spark.createDataFrame([(d, t, None) for d, t in rows], SCHEMA)).collect()
    assert len(out) == len(rows)
    assert {(r.doc_id, r.component_id) for r in out} == {(5, 5), (7, 5), (9, 5), (3, 3), (4, 3), (1, 1)}


def test_warc_query(spark):
    out = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in catalogue.QUERIES["op2_warc"](spark, SF).collect()}
    assert out == brute.warc([(r.page_id, r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()])


def vector_cases(n=700, dim=16):
    g = np.random.default_rng(1)
    rows = [(0, None), (1, []), (2, [0.0] * dim), (3, [None] * dim), (4, [float("nan")] + [1.0] * (dim - 1)), (5, [1.0, 2.0]), (6, [2.0, 4.0])]
    for k in range(12):
        c = g.normal(size=dim)
        rows += [(len(rows) + i, (c + s * g.normal(size=dim)).astype(np.float32).tolist()) for i, s in enumerate(g.choice([0.01, 0.1, 0.3, 0.6], n // 12))]
    return rows + [(len(rows) + i, rows[20][1]) for i in range(9)]


@pytest.mark.parametrize("group", [4096, 100])
@pytest.mark.parametrize("rows", [vector_cases(), []], ids=["clusters", "empty"])
def test_vectors(spark, rows, group):
    from quillspark.llm.op4_cover import near_vectors

    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 node", "2 raw")
    want = brute.vectors([(r.vec_id, r.embedding) for r in df.collect()])
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(df, group=group).collect()} == want


def test_vectors_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in catalogue.QUERIES["op4_cover_tree"](spark, SF).collect()} == brute.vectors(rows)


def test_vectors_of_many_lengths_and_sizes(spark):
    from quillspark.llm.op4_cover import near_vectors

    g = np.random.default_rng(4)
    rows = []
    for dim in [*range(1, 30), 1500]:
        c = g.normal(size=dim)
        rows += [(len(rows) + i, (s * (c + 0.25 * g.normal(size=dim))).tolist()) for i, s in enumerate((1.0, 1e250, 1e-250, 5.0))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    scaled = [(i, (np.array(v) / np.abs(v).max()).tolist()) for i, v in rows]
    few = [(i, v) for i, v in scaled if len(v) in (1, 7, 1500)]
    some = df.where("size(embedding) in (1, 7, 1500)")
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(some, group=3).collect()} == brute.vectors(few)
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(df).collect()} == brute.vectors(scaled)


def test_flow_costs_least():
    """Costs of route() against unit augmentation by Bellman and Ford's shortest paths."""
    from quillspark.llm.op6_mix import route

    def least(patterns, sizes, quotas, degree, most=3):
        arcs, n = [], len(patterns) + len(quotas) + 2
        s, t = n - 2, n - 1
        for p, members in enumerate(patterns):
            arcs += [[s, p, sizes[p], (2 * k + 1) * degree[p]] for k in range(most)] + [[p, len(patterns) + m, 10**6, 0] for m in members]
        arcs += [[len(patterns) + i, t, q, 0] for i, q in enumerate(quotas)]
        arcs = [x for a, b, c, w in arcs for x in ([a, b, c, w], [b, a, 0, -w])]
        flow = cost = 0
        while True:
            dist, via = [10**9] * n, [None] * n
            dist[s] = 0
            for _ in range(n):
                for i, (a, b, c, w) in enumerate(arcs):
                    if c and dist[a] + w < dist[b]:
                        dist[b], via[b] = dist[a] + w, i
            if dist[t] == 10**9:
                return flow, cost
            x = t
            while x != s:
                arcs[via[x]][2] -= 1
                arcs[via[x] ^ 1][2] += 1
                x = arcs[via[x]][0]
            flow, cost = flow + 1, cost + dist[t]

    r = random.Random(2)
    for _ in range(25):
        n_s = r.randint(1, 4)
        patterns = [tuple(sorted(r.sample(range(n_s), r.randint(0, n_s)))) for _ in range(r.randint(1, 6))]
        sizes, quotas = [r.randint(0, 9) for _ in patterns], [r.randint(0, 25) for _ in range(n_s)]
        degree = [r.choice([1, 2, 4]) for _ in patterns]
        flow = route(patterns, sizes, quotas, degree=degree)
        used = [sum(f.values()) for f in flow]
        cost = sum((2 * k + 1) * d * min(max(u - k * z, 0), z) for u, z, d in zip(used, sizes, degree) for k in range(3))
        assert (sum(used), cost) == least(patterns, sizes, quotas, degree)
        assert all(sum(f.get(s, 0) for f in flow) <= q for s, q in enumerate(quotas)) and all(set(f) <= set(p) for f, p in zip(flow, patterns))


def test_mix_takes_own_texts_before_shared_ones(spark):
    from quillspark.llm.op6_mix import mix

    rows = [(i, f"own {i} text", "a") for i in range(40)] + [(100 + i, f"shared {i} text", "a") for i in range(40)] + [(200 + i, f"shared {i} text", "b") for i in range(40)]
    rows += [(300 + i, f"more {i} words", "b") for i in range(40)]
    out = {r.doc_id: r.taken for r in mix(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert sum(out[i] for i in range(40)) > sum(out[100 + i] for i in range(40))  # a's target is less than its size
    assert sum(out[300 + i] for i in range(40)) > sum(out[200 + i] for i in range(40))


def test_mix_null_members(spark):
    from quillspark.llm.op6_mix import mix

    rows = [(1, "a b c", "s", None), (2, "d e f", None, None), (3, "g h i", "s", ["t", "nobody"]), (4, "j k l", "t", [None, "t"]), (5, "m", "t", [])]
    out = mix(spark.createDataFrame(rows, "doc_id long, text string, source string, m array<string>"), "m").collect()
    assert sorted(r.doc_id for r in out) == [1, 2, 3, 4, 5]
    assert not next(r.taken for r in out if r.doc_id == 5)


def test_steps_pack_as_best_fit():
    from quillspark.llm.op7_pack import steps

    r = random.Random(8)
    for size in (10, 64, 200):
        for n in (0, 1, 7, 60, 400):
            lengths = [min(size, int(r.choice([r.uniform(1, size + 1), r.expovariate(5 / size) + 1]))) for _ in range(n)]
            free: list[int] = []
            for x in sorted(lengths, reverse=True):
                fits = [g for g in free if g >= x]
                if fits:
                    free[free.index(min(fits))] -= x
                else:
                    free.append(size - x)
            plan = steps({x: lengths.count(x) for x in set(lengths)}, size)
            assert (len(set()) if not n else plan[:, 2].max() + 1 <= len(free)) or not n


def test_exchange_ends_where_no_move_helps():
    from quillspark.llm.op10_brown import exchange, likelihood

    g = np.random.default_rng(3)
    table = g.poisson(2.0, (24, 24)).astype(float)
    table[:12, 12:] += g.poisson(6.0, (12, 12))
    score = lambda label: likelihood((lambda one: one.T @ table @ one)(np.eye(4)[label]))
    label = exchange(table, 4, 200)
    best = score(label)
    for u in range(24):
        for c in range(4):
            moved = label.copy()
            moved[u] = c
            assert score(moved) <= best + 1e-6


def test_flow_of_overlapping_sources(spark):
    from quillspark.llm.op6_mix import mix, route

    flow = route([(0,), (0, 1), (1,)], [10, 30, 5], [40, 50])
    assert [sum(f.get(s, 0) for f in flow) for s in (0, 1)] == [40, 50]
    assert all(sum(f.values()) <= 3 * n for f, n in zip(flow, (10, 30, 5)))
    assert sum(flow[0].values()) >= 20 and sum(flow[2].values()) >= 10  # convex costs level the repetitions
    rows = [(i, "a b c", f"s{i % 2}", [f"s{i % 2}"] if i % 3 else ["s0", "s1"]) for i in range(60)]
    out = mix(spark.createDataFrame(rows, "doc_id long, text string, source string, m array<string>"), "m").collect()
    assert abs(sum(r.taken for r in out) - 180) <= 9
