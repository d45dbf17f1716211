"""Queries of the operators as registered, against brute force; odd column names, repeated rows, long texts, dense groups."""

import gzip
import math
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from test_llm import BPE, components_of, docs, plain_fingerprint, prose, quality_brute, record, simhash_brute

import corpus_pipeline
from tickloom.llm import bpe, embedding_dedup, langid, line_dedup, mixing, packing, quality, queries, shared, simhash, toxicity, warc


def written(tmp_path, df, name="documents"):
    df.write.mode("overwrite").parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def test_warc_query_with_repeated_ids(spark, tmp_path):
    pages = [(5, "AAA"), (5, "BBBBB"), (7, "AAA"), (5, "AAA"), (8, None), (9, ""), (10, "BBBBB"), (11, "é中"), (12, "é中"), (12, "é中")]
    sf = written(tmp_path, spark.createDataFrame([(k, "u", h) for k, h in pages], "page_id long, url string, html string"), "pages")
    got = queries.op8_warc(spark, sf)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet/*.parquet'")
    want = db.execute(queries.ORACLE_SQL["op8_warc"])
    names = [c[0] for c in want.description]
    assert sorted(map(str, got.select(*names).collect())) == sorted(map(str, spark.createDataFrame(want.fetchall(), got.select(*names).schema).collect()))
    assert got.count() == len(pages)


def test_salvage_of_members_with_many_records():
    bad = bytearray(b"".join(record(i, bytes([65 + i]) * 50) for i in range(4)))
    bad[bad.index(b"B" * 50) + 3] ^= 1  # one bad digest
    whole = gzip.compress(record(8, b"last"))
    found = list(warc.salvage(gzip.compress(bytes(bad)) + whole))
    assert [x[1][:1] for x in (w for k, _, _, w in found if k == "record")] == [b"H"] * 4 and [k for k, *_ in found] == ["record"] * 3 + ["gap", "record"]
    good = gzip.compress(b"".join(record(i, random.Random(i).randbytes(3000)) for i in range(5)))
    found = list(warc.salvage(good[: len(good) - 2000] + whole))
    assert [w[0]["x-page-id"] for k, _, _, w in found if k == "record"] == ["0", "1", "2", "3", "8"]
    assert sum(b - a for _, a, b, _ in found) == len(good) - 2000 + len(whole)


def test_vectors_in_doubles_and_of_many_lengths(spark):
    big = [1e300, 1e300, 0.0, 1e299]
    near = [1e300, 1e300 * (1 + 1e-9), 0.0, 1e299]
    rows = [(0, big, 1), (1, near, 1), (2, [x * 1e-300 * 1e-300 for x in big], 1), (3, [-1e300, 1.0, 0.0, 0.0], 1), (4, [float("inf"), 1.0, 0.0, 0.0], 1)]
    rows += [(10 + n, [1.0] * n, 1) for n in range(1, 12)] + [(30 + n, [2.0] * n, 1) for n in range(1, 12)]
    got = {r.vec_id: r for r in embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert [got[i].n_links for i in range(5)] == [2, 2, 2, 0, 0] and {got[i].component_id for i in range(3)} == {0}
    assert all(got[10 + n].n_links == got[30 + n].n_links == 1 and got[30 + n].component_id == 10 + n for n in range(1, 12))


@pytest.mark.parametrize("n", [1500, 4000])
def test_vector_recall(spark, n, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "SMALL_BLOCK", 64)  # so that the dense group is dealt in tiles
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 24))
    dense = x[0] + rng.normal(size=(500, 24)) * 0.12
    partner = x[: n // 3] + rng.normal(size=(n // 3, 24)) * 0.3
    x = np.concatenate([x, dense, partner])
    df = spark.createDataFrame([(i, v, i % 2) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_vectors(df).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    y = np.arange(len(x)) % 2
    hit = (u @ u.T >= 0.93) & (y[:, None] == y[None, :])
    np.fill_diagonal(hit, False)
    found = np.array([got[i] for i in range(len(x))])
    assert (found <= hit.sum(axis=1)).all() and found.sum() >= 0.97 * hit.sum() > 10_000


def test_large_buckets_in_tiles(spark):
    rng = np.random.default_rng(3)
    fps = {int(x) for x in rng.integers(0, 1 << 63, 60)}
    for centre in list(fps)[:3]:
        for _ in range(120):
            x = centre
            for b in rng.choice(64, rng.integers(1, 6), replace=False):
                x ^= 1 << int(b)
            fps.add(x - (1 << 64) if x >= 1 << 63 else x)
    fps = sorted(fps)
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    links = [(r.src, r.dst) for r in simhash.fingerprint_links(df, block=16).collect()]
    near = lambda a, b: ((a ^ b) % (1 << 64)).bit_count() <= 4
    assert all(near(a, b) for a, b in links)
    pairs = [(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if near(a, b)]
    assert components_of(fps, links) == components_of(fps, pairs)


ODD = ["a.b", "__gone", "__row_hash", "__th", "row", "TH", "size", "gone", "copy", "chosen_id", "x`y"]


def test_stages_keep_odd_columns(spark, tmp_path):
    rng = random.Random(21)
    passage = "\n".join(prose(rng, 30, 4000) for _ in range(9))
    texts = [f"{prose(rng, 60, 4000)}\n{passage}\n{prose(rng, 20, 4000)}" for _ in range(6)]
    texts += [texts[0], None, "", prose(rng, 80, 4000)]
    base = docs(spark, texts, ids=[0, 1, 2, 3, 3, 5, 0, 7, 8, 9])
    df = base.toDF(*base.columns)
    for i, name in enumerate(ODD):
        df = df.withColumn(name, (df.doc_id * 100 + i).cast("long"))
    plain = base
    for (name, stage), kind in zip(corpus_pipeline.STAGES, "qlnmp", strict=True):
        got, want = stage(spark, df, ""), stage(spark, plain, "")
        if kind == "p":
            key = lambda r: (r.doc_id is None, r.doc_id or 0, r.start, bytes(r.ids))
            assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))
            continue
        assert got.columns == df.columns
        rows = got.collect()
        for r in rows:
            assert [r[n] for n in ODD] == [r["doc_id"] * 100 + i for i in range(len(ODD))]
        assert sorted((r["doc_id"], r["text"] or "") for r in rows) == sorted((r["doc_id"], r["text"] or "") for r in want.collect())
        assert stage(spark, df.where("false"), "").count() == 0


def test_mix_reruns_agree_on_ties(spark):
    texts = [f"{w} " * 40 for w in "abcdefghij"]
    ids = [1] * 10  # one id and size: only the texts tell the rows apart
    a = sorted(map(str, mixing.mixed_documents(docs(spark, texts, lambda i: "s", ids)).collect()))
    b = sorted(map(str, mixing.mixed_documents(docs(spark, texts, lambda i: "s", ids).repartition(7).orderBy("text")).collect()))
    assert a == b


def letters_model():
    words = {"de": {"▁der": 5, "▁die": 4, "▁weil": 2}, "en": {"▁the": 6, "▁while": 2, "▁did": 1}}
    from collections import Counter

    return langid.fit_languages({k: Counter(v) for k, v in words.items()}, ["▁", "▁d", "▁de", "▁der", "▁the", "th", "the", "e", "er", "r", "d", "h", "t", "i", "ie", "w", "l", "wh", "while"])


def piece_probabilities(model, pieces):
    from tickloom.llm.ngrams import char_matrix, substring_hashes

    at = {int(k): i for i, k in enumerate(model.keys)}
    return {p: model.prob[at[int(substring_hashes(char_matrix([p]), len(p))[-1][0, 0])]] for p in pieces if int(substring_hashes(char_matrix([p]), len(p))[-1][0, 0]) in at}


def test_language_query_rows_by_brute_force(spark):
    """Predictions and scores of detect_language by summing segmentations one by one, over whole texts."""
    pieces = ["▁", "▁d", "▁de", "▁der", "▁the", "th", "the", "e", "er", "r", "d", "h", "t", "i", "ie", "w", "l", "wh", "while"]
    model = letters_model()
    prob = piece_probabilities(model, pieces)

    def word(w):
        sums = [np.ones(2)] + [np.zeros(2) for _ in w]
        for j in range(1, len(w) + 1):
            for k in range(1, j + 1):
                p = prob.get(w[j - k : j], np.zeros(2))
                sums[j] = sums[j] + sums[j - k] * (np.maximum(p, langid.FLOOR) if k == 1 else p)
        return np.log(sums[-1])

    texts = ["der die", "The WHILE!", "½ ² Ⅷ", "²der²die½", "x", "der" * 9, "die the der while", None, "12 ...", "weiltheder q"]
    rows = {r.doc_id: r for r in langid.detect_language(docs(spark, texts), model).collect()}
    for i, t in enumerate(texts):
        cleaned = "".join(c if c.isalpha() else " " for c in (t or "").lower()).split()
        if not cleaned:
            assert (rows[i].lang_pred, rows[i].score) == ("und", 0)
            continue
        total, letters = sum(word("▁" + w) for w in cleaned), sum(len(w) + 1 for w in cleaned)
        z = np.exp((total - total.max()) / letters * min(letters, 40))
        assert rows[i].lang_pred == ["de", "en"][int(total.argmax())] and rows[i].score == pytest.approx(z.max() / z.sum())


def test_long_words_are_summed_whole():
    model = letters_model()
    short = "▁" + "derwhile" * 3
    assert np.allclose(langid._long_score(short, model), langid.word_scores([short], model)[0])
    old, langid.ROWS = langid.ROWS, 7  # parts of a few characters give the same sums
    try:
        assert np.allclose(langid._long_score(short, model), langid.word_scores([short], model)[0])
    finally:
        langid.ROWS = old
    assert np.isfinite(langid.word_scores(["▁" + "zq" * 50_000], model)).all()


def test_toxicity_scores_by_brute_force(spark):
    """score_toxicity against the mean over words of the mean of their subwords' weights, subword by subword."""
    rng = random.Random(2)
    bags = [{rng.choice(["vile", "good", "plain", "dull"]): 2, f"w{'abc'[rng.randrange(3)]}": 1} for _ in range(60)]
    model = toxicity.fit_toxicity(bags, np.array([int("vile" in b) for b in bags]), 0.3, z_least=1.0)

    def weight(word):
        marked = f"<{word}>"
        subs = [marked[a : a + m] for m in sorted({3, 4, 5, 6, len(marked)}) if m <= len(marked) for a in range(len(marked) - m + 1)]
        out = []
        for s in subs:
            h = 0
            for k, c in enumerate(s):
                h = (ord(c) + 1) if k == 0 else (h * 0x100000001B3 + ord(c) + 1) % (1 << 64)
            out.append(model.weight[(h * 0x9E3779B97F4A7C15) % (1 << 64) >> (64 - 17)])
        return float(np.mean(out))

    texts = ["vile good", "Good, good plain-dull", "viile vil vilest", "", None, "12", "vile " * 5000]
    rows = {r.doc_id: r for r in toxicity.score_toxicity(docs(spark, texts), model).collect()}
    for i, t in enumerate(texts):
        words = "".join(c if c.isalpha() else " " for c in (t or "").lower()).split()
        mean = np.mean([weight(w) for w in words]) if words else 0.0
        score = 1 / (1 + math.exp(-(model.scale * mean + model.shift)))
        assert rows[i].score == pytest.approx(score, rel=1e-4) and rows[i].predicted == int(score >= 0.7)


def test_queries_on_one_small_table(spark, tmp_path):
    """Every query's columns, held_out flags, digests and counts on one table with nulls, empties and repeated rows."""
    rng = random.Random(8)
    words = {"en": "the of and is was this that with from".split(), "de": "der die und nicht ein mit von zu auf".split()}
    rows = []
    for i in range(60):
        lang = "en" if i % 2 else "de"
        text = " ".join(rng.choice(words[lang]) for _ in range(60)) + (" vilest scum" * 3 if i % 5 == 0 else "")
        rows.append((i, text, lang, f"s{i % 4}", len(text)))
    rows += [rows[3], (61, None, None, None, 0), (62, "", "en", "s1", 0), (None, rows[4][1], "de", "s0", 9), (63, "½ ²", "en", "s1", 3), (64, "x" * 200_000, "en", "s1", 200_000)]
    sf = written(tmp_path, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    written(tmp_path, spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(50)] + [(51, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int"), "labels")
    ids = sorted((r[0] is None, r[0] or 0) for r in rows)
    same = lambda df: sorted((r.doc_id is None, r.doc_id or 0) for r in df.collect()) == ids
    crc = lambda k, m: zlib.crc32(str(k).encode()) % m if k is not None else None
    tox = queries.op3_toxicity(spark, sf)
    assert same(tox) and tox.columns == ["doc_id", "held_out", "score", "predicted"]
    for r in tox.collect():
        assert r.held_out == (crc(r.doc_id, 3) == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    lang = queries.op7_langid(spark, sf)
    assert same(lang) and lang.columns == ["doc_id", "held_out", "lang_pred", "score"]
    for r in lang.collect():
        assert r.held_out == (crc(r.doc_id, 5) == 0) and 0 <= r.score <= 1
        assert r.lang_pred == ("und" if r.doc_id in (61, 62, 63) else "en" if (r.doc_id or 0) % 2 else "de") or r.doc_id == 64
    fp, parts = simhash_brute([r[1] for r in rows])
    least = defaultdict(lambda: 1 << 62)
    for i, r in enumerate(rows):
        least[parts[i]] = min(least[parts[i]], 1 << 62 if r[0] is None else r[0])
    found = sorted(map(tuple, queries.op5_simhash(spark, sf).collect()), key=str)
    assert found == sorted(((r[0], f"{fp[i]:016x}", least[parts[i]]) for i, r in enumerate(rows)), key=str)
    assert plain_fingerprint(None) == 0
    good = {tuple(r) for r in queries.op10_quality(spark, sf).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat", "base_failed", "kept").collect()}
    assert good == {(r[0], *quality_brute(r[1], quality.QualityRules())) for r in rows}
    assert same(queries.op9_token_count(spark, sf)) and same(queries.op6_mixing(spark, sf)) and same(queries.op2_line_dedup(spark, sf))
    for name in queries.QUERIES:  # and on empty tables
        empty = tmp_path / "empty"
        for table, df in (("documents", spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")), ("labels", spark.createDataFrame([], "doc_id long, quality int, toxic int")), ("pages", spark.createDataFrame([], "page_id long, url string, html string")), ("embeddings", spark.createDataFrame([], "vec_id long, embedding array<float>, label int"))):
            df.write.mode("ignore").parquet(str(empty / f"{table}.parquet"))
        assert queries.QUERIES[name](spark, str(empty)).count() == 0, name


def test_very_long_texts(spark, tmp_path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(BPE)
    texts = [" " * 5_000_000, "\n" * 5_000_000, ("word " * 1_000_000).strip(), "the end\n" * 600_000]
    df = docs(spark, texts).repartition(4)
    by = defaultdict(int)
    for r in packing.pack(df, BPE).select("doc_id", "length").collect():
        by[r.doc_id] += r.length
    counted = {r.doc_id: r.n_tokens for r in queries.count_tokens(df, BPE).collect()}
    for i, t in enumerate(texts):
        n = len(tokenizer.encode(t, add_special_tokens=False).ids)
        assert by[i] == n + 1 and counted[i] == n
    out = {r.doc_id: len(r.text) for r in line_dedup.dedup_passages(df).collect()}
    assert out[0] == 5_000_000 and out[1] == 5_000_000 and out[3] < 100
    assert {r.doc_id: r.kept for r in quality.score_quality(df).collect()} == dict.fromkeys(range(4), False)
    assert simhash.near_duplicates(df).count() == 4
    assert bpe.heap_token_count("a" * 100_000, bpe.merge_ranks(BPE)) == len(tokenizer.encode("a" * 100_000, add_special_tokens=False).ids)


def test_shared_folder_rule(spark):
    class Context:
        master = "spark://somewhere:7077"
        getConf = staticmethod(lambda: {})
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError, match="share"):
        shared.checkpoint_root(Session())


