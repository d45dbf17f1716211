"""The ten operators against brute force, round trips and held-out rows; nulls, empties, ties, extra columns, empty tables."""

import hashlib
import itertools
import math
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from tickloom.llm import langid, line_dedup, mixing, packing, quality, queries, shared, simhash, token_count, toxicity, warc
from tickloom.llm.embedding_dedup import fit_index, near_vectors, traverse
from tickloom.llm.packing import binary_lengths

DOC = "doc_id long, text string, lang string, source string, n_chars long"
BPE = queries.vocabulary("byte_bpe_50k.json")


def docs(spark, texts, source=lambda i: f"s{i % 3}", ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(k, t, "en", source(i), len(t or "")) for i, (k, t) in enumerate(zip(ids, texts, strict=True))], DOC)


def prose(rng, n, vocab=400):
    return " ".join(f"w{rng.randrange(vocab)}" for _ in range(n))


HARD = [None, "", " ", "a", "a", "two\n\n lines\t\r\n", "x" * 30_000, "é 中文 😀 \x1c\x85 　", "<|endoftext|> b <|endoftext|>", "\n", "word " * 3000]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BPE)


def fuzz(n=3000, seed=5):
    rng = random.Random(seed)
    parts = ["a", "b", "The", " ", "  ", "\n", "\n\n", "\t", "\r", "\x1c", "\x85", "\xa0", "　", "é", "ß", "'s", "'ll", "12", "½", "٣", ".", "!!", "<|endoftext|>", "<|", "😀", "中", "́", "​", "\x00", "ing"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def test_packing(spark, tokenizer):
    texts = HARD + fuzz(500)
    df = docs(spark, texts).selectExpr("*", "1 as start", "2 as ids")  # extra columns with clashing names
    rows = packing.pack(df, BPE).collect()
    by, sequences = defaultdict(list), set()
    for r in rows:
        by[r.doc_id].append(r)
        sequences.add(r.sequence_id)
        assert r.length & (r.length - 1) == 0 and r.length <= 1024 and r.offset == 0 and 1 << r.bucket == r.length
    assert len(sequences) == len(rows)
    for i, t in enumerate(texts):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        got = sorted(by[i], key=lambda r: r.start)
        assert b"".join(r.ids for r in got) == struct.pack(f"<{len(ids)}I", *ids)
        assert [r.start for r in got] == [sum(r.length for r in got[:k]) for k in range(len(got))] and all(r.doc_tokens == len(ids) for r in got)
    assert binary_lengths(1024 * 2 + 5, 1024) == [1024, 1024, 4, 1]
    assert packing.pack(df.where("false"), BPE).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, BPE, max_len=1000)


def test_packing_query_digest(spark, tmp_path):
    docs(spark, ["hello world", None]).write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r.doc_id: r for r in queries.op1_packing(spark, str(tmp_path)).where("start = 0").collect()}
    assert rows[1].ids_crc32 == zlib.crc32(b"\0\0\0\0") and rows[1].doc_tokens == 1


def test_packing_long_white_space(spark, tokenizer):
    texts = ["a" + " " * 1_100_000 + "b <|endoftext|>c", "\n" * 1_100_000, "d" + "\t " * 300_000]
    by = defaultdict(list)
    for r in packing.pack(docs(spark, texts), BPE).collect():
        by[r.doc_id].append(r)
    for i, t in enumerate(texts):
        ids = tokenizer.encode(t, add_special_tokens=False).ids + [0]
        assert b"".join(r.ids for r in sorted(by[i], key=lambda r: r.start)) == struct.pack(f"<{len(ids)}I", *ids)


def test_token_counts(spark, tokenizer):
    texts = HARD + fuzz(1500, 6)
    rows = {r.doc_id: r for r in token_count.count_tokens(docs(spark, texts).selectExpr("*", "1 as n_tokens"), BPE).collect()}
    for i, t in enumerate(texts):
        n = len(tokenizer.encode(t or "", add_special_tokens=False).ids)
        assert (rows[i].n_tokens, rows[i].n_bytes, rows[i].over_limit) == (n, len((t or "").encode()), n > 1024)
    assert token_count.count_tokens(docs(spark, ["a"], ids=[None]), BPE).first().n_tokens == 1
    assert token_count.count_tokens(docs(spark, ["a"]).where("false"), BPE).count() == 0


def dedup_brute(rows, rules):
    """(id, text) pairs to cleaned texts: a chunk goes if an earlier one has its bytes."""
    seen, out = set(), {}
    for k, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        if t is None:
            out[k] = None
            continue
        lines, left = t.encode().split(b"\n"), []
        for a, b, compared in line_dedup.line_chunks(t.encode(), rules):
            data = b"\n".join(lines[a:b])
            if compared and data in seen:
                continue
            if compared:
                seen.add(data)
            left += lines[a:b]
        out[k] = b"\n".join(left).decode()
    return out


def test_line_dedup(spark):
    rng = random.Random(1)
    passage = "\n".join(prose(rng, 12) for _ in range(9))
    long_line = prose(rng, 60)
    texts = HARD[:7] + ["\n".join([prose(rng, 8), passage, prose(rng, 8), long_line]) for _ in range(6)] + [passage + "\nend", "only short", "only short"]
    df = docs(spark, texts).selectExpr("*", "true as no", "1 as data")
    out = line_dedup.dedup_lines(df, removed_col="gone")
    assert out.columns == [*df.columns, "gone"]
    got = {r.doc_id: r.text for r in out.collect()}
    assert got == dedup_brute(list(enumerate(texts)), line_dedup.ChunkRules())
    whole = "\n".join(t for t in got.values() if t)
    assert whole.count(long_line) == 1
    assert sum(whole.count(line) for line in passage.split("\n")) < 9 * 7 * 0.75
    assert got[14] == got[15] == "only short"  # single short lines are no multi-line chunks
    assert line_dedup.dedup_lines(df.where("false")).count() == 0
    # inserting a line at the front moves no later boundary
    a, b = (line_dedup.line_chunks(t.encode(), line_dedup.ChunkRules()) for t in (passage, "new line\n" + passage))
    assert len({(x + 1, y + 1) for x, y, _ in a} & {(x, y) for x, y, _ in b}) >= len(a) - 2
    twin = docs(spark, ["a\nb\nc\nd"] * 2, ids=[7, 7])  # equal id and text: one document
    assert [r.text for r in line_dedup.dedup_lines(twin).collect()] == ["a\nb\nc\nd"] * 2


def passages_brute(texts, min_words=50):
    """Cleaned texts and lines removed, by growing every match of two lines; no chunks or pairs."""
    places = [(d, i, line) for d, t in enumerate(texts) for i, line in enumerate((t or "").split("\n"))]
    lines = [(t or "").split("\n") for t in texts]
    gone = set()
    by = defaultdict(list)
    for d, i, line in places:
        if not line.split():
            continue
        for e, j in by[line]:
            k, worded, last = 0, 0, 0
            while i + k < len(lines[d]) and j + k < len(lines[e]) and lines[d][i + k] == lines[e][j + k]:
                worded += bool(lines[d][i + k].split())
                last = k if lines[d][i + k].split() else last
                k += 1
            if worded > 1 or sum(len(x.split()) for x in lines[d][i : i + k]) >= min_words:
                gone |= {(d, i + x) for x in range(last + 1)}
        by[line].append((d, i))
    left = [None if t is None else "\n".join(x for i, x in enumerate(lines[d]) if (d, i) not in gone) for d, t in enumerate(texts)]
    return [(t, sum((d, i) in gone for i in range(len(lines[d])))) for d, t in enumerate(left)]


def test_op2_passages_between_foreign_lines(spark, tmp_path):
    rng = random.Random(11)
    planted = ["\n".join(prose(rng, w, 5000) for _ in range(n)) for n, w in ((2, 30), (3, 20), (4, 15), (5, 15), (6, 12), (12, 10), (1, 60))]
    planted.append("\n\n".join(prose(rng, 20, 5000) for _ in range(3)))
    texts = [None, "", "\n", "one\nline\none\nline", "single short", "single short"]
    for _ in range(5):
        for p in planted:
            texts.append("\n".join([prose(rng, 9), p, prose(rng, 9), "", prose(rng, 7)]))
    few = ["a b", "c d", "e", "", " ", "f\t"]
    texts += ["\n".join(rng.choice(few) for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    docs(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.text, r.n_removed_lines) for r in queries.op2_line_dedup(spark, str(tmp_path)).collect()}
    assert [got[i] for i in range(len(texts))] == passages_brute(texts)
    whole = "\n".join(t for t, _ in got.values() if t).split("\n")
    assert all(whole.count(line) == 1 for p in planted for line in p.split("\n") if line)


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_of(nodes, linked):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in linked:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    return {n: find(n) for n in nodes}


def simhash_brute(texts):
    fp = [plain_fingerprint(t) for t in texts]
    pairs = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if (fp[i] ^ fp[j]).bit_count() <= 4]
    return fp, components_of(range(len(texts)), pairs)


def near_texts():
    rng = random.Random(3)
    base = [prose(rng, 150) for _ in range(12)]
    texts = list(base) + base[:3]
    for t in base[:6]:
        for _ in range(12):
            w = t.split()
            w[rng.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
    return texts + ["A b", "a B", None, "", " \t", "x y z", "é" * 3000]


def test_simhash(spark):
    texts = near_texts()
    fp, parts = simhash_brute(texts)
    rows = {r.doc_id: r for r in simhash.near_duplicates(docs(spark, texts).selectExpr("*", "1 as fp", "2 as component_id")).collect()}
    assert all(rows[i].fp % (1 << 64) == fp[i] and rows[i].component_id == parts[i] for i in range(len(texts)))
    kept = simhash.keep_one(docs(spark, texts))
    assert kept.columns == docs(spark, texts).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(parts.values()))
    assert simhash.near_duplicates(docs(spark, ["a"]).where("false")).count() == 0
    odd = simhash.keep_one(docs(spark, ["one two", "one two", "one two", "other words here"], ids=[None, 3, 3, None]))
    assert sorted((r.doc_id is None, r.text) for r in odd.collect()) == [(False, "one two"), (True, "other words here")]


def test_keep_one_of_near_copies_without_ids(spark):
    rng = random.Random(12)
    base = prose(rng, 400, 5000)
    texts = [base, *(base + f" end{i}" for i in range(20)), prose(rng, 400, 5000)]
    fp, parts = simhash_brute(texts)
    assert len(set(fp)) > len(set(parts.values()))  # near, not only equal, fingerprints
    assert simhash.keep_one(docs(spark, texts, ids=[None] * len(texts))).count() == len(set(parts.values()))


def test_bucket_links_keep_components():
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 1 << 63, 4, dtype=np.uint64)
    fps = {int(c) for c in centres}
    for c in centres:  # dense groups, larger than a small bucket
        for _ in range(150):
            x = int(c)
            for b in rng.choice(64, rng.integers(1, 6), replace=False):
                x ^= 1 << int(b)
            fps.add(x)
    fps = np.array(sorted(fps), np.uint64)
    keys, rows = [], []
    for low, width in simhash.segments(4):
        for bit in range(low, low + width):
            mask = np.uint64(((1 << width) - 1) & ~(1 << (bit - low)))
            keys.append(((fps >> np.uint64(low)) & mask).astype(np.int64) + (bit << 32))
            rows.append(fps)
    keys, rows = np.concatenate(keys), np.concatenate(rows)
    order = np.argsort(keys, kind="stable")
    a, b = simhash.bucket_links(keys[order], rows[order], 4)
    assert (np.bitwise_count(a ^ b) <= 4).all()
    own = fps.tolist()
    pairs = [(x, y) for x, y in itertools.combinations(own, 2) if (x ^ y).bit_count() <= 4]
    assert components_of(own, zip(a.tolist(), b.tolist(), strict=True)) == components_of(own, pairs)
    assert len(a) < len(pairs) * 4


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)] + [(500, i) for i in range(501, 600)] + [(7, 7)]
    want = components_of({x for e in edges if e[0] != e[1] for x in e}, edges[:-1])
    got = {r.node: r.component for r in shared.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == want
    assert shared.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def mix_brute(rows, weights=(3, 1, 2), share=1.5, most=2, seed=42):
    """rows: (id, text, source) to {(id, place): (size, target, taken)}, by clamping in rounds."""
    size = [len((t or "").encode().split()) for _, t, _ in rows]
    total = defaultdict(int)
    for (_, _, s), n in zip(rows, size, strict=True):
        total[s] += n
    order = sorted(total, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    clamped: set = set()
    while True:
        left = share * sum(total.values()) - sum(most * total[s] for s in clamped)
        w = sum(weight[s] for s in order if s not in clamped)
        target = {s: float(most * total[s]) if s in clamped else weight[s] * left / w for s in order}
        over = {s for s in order if s not in clamped and target[s] >= most * total[s]}
        if not over:
            break
        clamped |= over
    taken = [0] * len(rows)
    for s in order:
        mine = [i for i, r in enumerate(rows) if r[2] == s]
        whole = int(target[s] // total[s]) if total[s] else 0
        rest = int(target[s]) - whole * total[s]
        key = lambda i: (hashlib.md5(f"{seed}#{'' if rows[i][0] is None else rows[i][0]}".encode()).hexdigest()[:15], rows[i][0] or 0, size[i])
        for i in sorted(mine, key=key):
            part = max(0, min(size[i], rest))
            rest -= part
            taken[i] = whole * size[i] + part
    return size, [target[r[2]] for r in rows], taken, total


def test_mixing(spark):
    rng = random.Random(4)
    texts = [prose(rng, rng.randrange(1, 200)) for _ in range(120)] + [None, "", "one"]
    source = lambda i: None if i == 121 or i % 17 == 0 else "hot" if i % 3 == 0 else f"s{i % 5}"
    df = docs(spark, texts, source)
    rows = mixing.mix(df.selectExpr("*", "1 as size", "2 as target")).collect()
    size, target, taken, total = mix_brute([(i, t, source(i)) for i, t in enumerate(texts)])
    assert len(rows) == len(texts)
    for r in rows:
        assert (r["size"], r.taken, r.source_size) == (size[r.doc_id], taken[r.doc_id], total[r.source]) and r.target == pytest.approx(target[r.doc_id])
        assert 0 <= r.taken <= 2 * r["size"]
    sums = Counter()
    for r in rows:
        sums[r.source] += r.taken
    assert all(math.floor(target[i]) == sums[source(i)] for i in range(len(texts)))
    mixed = mixing.mixed_documents(df)
    assert mixed.columns == df.columns
    words = Counter()
    for r in mixed.collect():
        words[r.doc_id] += len(r.text.split())
    assert all(words[i] == taken[i] for i in range(len(texts)))
    assert mixing.mix(df.where("false")).count() == mixing.mixed_documents(df.where("false")).count() == 0
    assert [r.taken for r in mixing.mix(docs(spark, [None, ""], ids=[None, None])).collect()] == [0, 0]


def test_forward_sums_all_segmentations():
    pieces = ["▁a", "▁ab", "b", "c", "bc", "▁abc", "a"]
    model = langid.fit_languages({"x": Counter({"▁abc": 3, "▁ab": 1, "▁a": 2})}, pieces)
    at = {p: i for i, p in enumerate(pieces)}
    order = {int(k): i for i, k in enumerate(model.keys)}
    from tickloom.llm.ngrams import char_matrix, substring_hashes

    prob = {p: model.prob[order[int(substring_hashes(char_matrix([p]), len(p))[-1][0, 0])], 0] for p in at}

    def total(word):
        return 1.0 if not word else sum((prob.get(word[:k]) or (langid.FLOOR if k == 1 else 0)) * total(word[k:]) for k in range(1, len(word) + 1))

    for word in ("▁abc", "▁a", "▁abbc", "▁az"):
        assert langid.word_scores([word], model)[0, 0] == pytest.approx(math.log(total(word)))
    assert sum(prob.values()) == pytest.approx(1, abs=1e-2)


def test_language_id(spark):
    rng = random.Random(5)
    words = {"en": "the of and is was this that with from".split(), "de": "der die und nicht ein mit von zu auf".split()}
    rows = [(i, " ".join(rng.choice(words[g]) for _ in range(20)), g) for i, g in enumerate(["en", "de"] * 40)]
    df = spark.createDataFrame([*rows, (900, None, "en"), (901, "nicht der", None)], "doc_id long, text string, lang string")
    model = langid.train_languages(df, queries.vocabulary("piece_bpe_32k.model"))
    test = spark.createDataFrame([(1, "this is the", 1), (2, "DER und DIE!", 1), (3, None, 1), (4, "12 34 ...", 1), (5, "", 1), (None, "with that", 1), (7, "und " * 20_000, 1), (8, "und" * 20_000, 1)], "doc_id long, text string, score int")
    got = {r.doc_id: r for r in langid.detect_language(test, model).collect()}
    assert [got[k].lang_pred for k in (1, 2, 3, 4, 5, None, 7)] == ["en", "de", "und", "und", "und", "en", "de"]
    assert all(0 <= r.score <= 1 for r in got.values()) and got[3].score == 0
    assert langid.detect_language(test.where("false"), model).count() == 0
    empty = langid.train_languages(df.where("false"), queries.vocabulary("piece_bpe_32k.model"))
    assert {r.lang_pred for r in langid.detect_language(test, empty).collect()} == {"und"}


def test_toxicity(spark):
    rng = random.Random(6)
    rows = []
    for i in range(300):
        w = prose(rng, 60, 50).replace("w", "word").split()
        if i % 3 == 0:
            for k in range(4):
                w[rng.randrange(60)] = rng.choice(["horrible", "awful", "nasty"])
        rows.append((i, " ".join("".join(chr(97 + int(c)) if c.isdigit() else c for c in x) for x in w), int(i % 3 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train_toxicity(df.where("doc_id % 5 > 0"))
    got = {r.doc_id: r for r in toxicity.score_toxicity(df.withColumn("score", df.toxic), model).collect()}
    held = [r for r in rows if r[0] % 5 == 0]
    assert sum(got[i].predicted == y for i, _, y in held) >= 0.95 * len(held)
    misspelt = spark.createDataFrame([(1, rows[1][1] + " horribble awfful nassty horriblle"), (2, None), (3, ""), (None, rows[1][1])], "doc_id long, text string")
    score = {r.doc_id: r.score for r in toxicity.score_toxicity(misspelt, model).collect()}
    assert score[1] > score[None] and score[2] == score[3] and all(0 <= s <= 1 for s in score.values())
    assert toxicity.score_toxicity(df.where("false"), model).count() == 0
    assert 0 <= toxicity.score_toxicity(df, toxicity.train_toxicity(df.where("false"))).first().score <= 1


def record(i, payload, kind="response"):
    return warc.record_bytes({"WARC-Type": kind, "WARC-Record-ID": f"<urn:page:{i}>", "X-Page-ID": str(i)}, b"HTTP/1.1 200 OK\r\n\r\n" + payload)


def test_salvage():
    import gzip

    members = [gzip.compress(record(i, bytes([65 + i]) * 200)) for i in range(5)]
    data = b"".join(members)
    starts = [sum(map(len, members[:i])) for i in range(6)]
    bad = bytearray(data)
    bad[starts[1] + 30] ^= 255
    found = list(warc.salvage(bytes(bad)))
    assert [(k, a, b) for k, a, b, _ in found] == [("record", starts[0], starts[1]), ("gap", starts[1], starts[2]), *(("record", starts[i], starts[i + 1]) for i in (2, 3, 4))]
    plain = [record(i, b"x" * i) for i in range(3)]
    text = plain[0] + b"garbage\r\n" + plain[1] + plain[2][:-20]
    found = list(warc.salvage(text))
    assert [k for k, *_ in found] == ["record", "gap", "record", "gap"] and found[-1][2] == len(text)
    for cut in (0, 7, len(data) - 3):
        spans = [(a, b) for _, a, b, _ in warc.salvage(data[:cut])]
        assert sum(b - a for a, b in spans) == cut
    wrong = plain[1].replace(b"xHTTP", b"x").replace(b"\r\n\r\nHTTP", b"\r\n\r\nHTTQ")
    assert [k for k, *_ in warc.salvage(plain[0] + wrong + plain[2])] == ["record", "gap", "record"]
    mixed = members[0] + plain[1] + b"\x1f\x8b\x08junk" + members[2]
    assert [k for k, *_ in warc.salvage(mixed)] == ["record", "record", "gap", "record"]


def test_warc_round_trip(spark, tmp_path):
    pages = [(1, "http://a", "one"), (2, "u\r\nX: y", "one"), (3, None, None), (4, "v", ""), (None, "w", "one"), (5, "é", "é" * 50_000), (5, "é", "é" * 50_000), (9, "z", "one")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 as digest", "2 as payload")
    root = f"file://{tmp_path}/w"
    assert sum(r.records for r in warc.write_archives(df, root, roll_bytes=300).collect()) == len(pages)
    back = warc.read_archives(spark, root).collect()
    assert all(r.kind == "record" for r in back)
    got = sorted(((r.page_id or 0, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload).decode()) for r in back), key=repr)
    big = "é" * 50_000
    want = [(0, "response", None, "one"), (1, "response", None, "one"), (2, "revisit", 1, None), (3, "response", None, ""), (4, "revisit", 3, None)]
    assert got == sorted([*want, (5, "response", None, big), (5, "response", None, big), (9, "revisit", 1, None)], key=repr)
    assert all(r.payload_digest == warc.sha1_base32(b"one") for r in back if r.page_id in (1, 2, 9))
    small = warc.write_archives(df, f"file://{tmp_path}/s", min_payload=4)
    small.count()
    assert {r.record_type for r in warc.read_archives(spark, f"file://{tmp_path}/s").where("page_id < 5").collect()} == {"response"}
    assert warc.write_archives(df.where("false"), f"file://{tmp_path}/n").count() == 0


def vectors(seed=7, groups=12, dense=60):
    rng = np.random.default_rng(seed)
    unit = lambda x: x / np.linalg.norm(x)
    out = [unit(rng.normal(size=16)) for _ in range(300)]
    for g in range(groups):
        for cosine in (0.95, 0.97, 0.99, 0.94):
            noise = unit(rng.normal(size=16))
            out.append(unit(cosine * out[g] + math.sqrt(1 - cosine**2) * unit(noise - noise.dot(out[g]) * out[g])))
    out += [unit(out[50] + rng.normal(size=16) * 0.03) for _ in range(dense)] + [out[60]] * 5
    return [[float(np.float32(x)) for x in v] for v in out]


def test_embedding_dedup(spark):
    vec = vectors()
    label = [i % 2 if i >= 300 else 0 for i in range(len(vec))]
    rows = [(i, v, y) for i, (v, y) in enumerate(zip(vec, label, strict=True))]
    n = len(rows)
    rows += [(n, None, 0), (n + 1, [0.0] * 16, 0), (n + 2, [float("nan")] * 16, 0), (n + 3, [None] * 16, 0), (n + 4, vec[0], None), (n + 5, [1.0] * 5, 0), (n + 6, [1.0] * 5, 0), (n + 7, [], 0), (n + 8, [x * 2 for x in vec[1]], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 as n", "2 as mult")
    got = {r.vec_id: r for r in near_vectors(df).collect()}
    assert len(got) == len(rows)
    x = np.array([v for v in vec] + [[x * 2 for x in vec[1]]], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids, y = [*range(n), n + 8], np.array([*label, 0])
    hit = (x @ x.T >= 0.93) & (y[:, None] == y[None, :])
    np.fill_diagonal(hit, False)
    true = hit.sum()
    found = sum(got[i].n_links for i in ids)
    assert all(got[i].n_links <= d for i, d in zip(ids, hit.sum(axis=1), strict=True))
    assert found >= 0.97 * true
    parts = components_of(ids, ((ids[a], ids[b]) for a, b in zip(*np.nonzero(hit), strict=True)))
    assert sum(got[i].component_id == parts[i] for i in ids) >= 0.97 * len(ids)
    assert [got[n + k].n_links for k in range(8)] == [0, 0, 0, 0, 0, 1, 1, 0]
    assert all(got[n + k].component_id == n + k and got[n + k].kept for k in (0, 1, 2, 3, 4, 7)) and got[n + 6].component_id == n + 5
    assert near_vectors(df.where("false")).count() == 0


def test_traversal_order():
    rng = np.random.default_rng(1)
    da, db = rng.random(9), rng.random(7)
    cells = traverse(da, db, 0.8)
    sums = [da[i] + db[j] for i, j in cells]
    assert sums == sorted(sums) and len(cells) == ((da[:, None] + db[None, :]) <= da.min() + db.min() + 0.8).sum() == len(set(cells))
    assert fit_index(rng.normal(size=(5, 4)), 8, 0.9).reach > 0


def quality_brute(text, rules):
    words = (text or "").encode().split()
    n = len(words)
    longest = [0] * n
    for i in range(n):
        for j in range(n):
            if i != j:
                k = 0
                while max(i, j) + k < n and words[i + k] == words[j + k]:
                    k += 1
                longest[i] = max(longest[i], k)
    grams = Counter(tuple(words[i : i + 3]) for i in range(n - 2))
    rep = {i + d for i in range(n - 2) if grams[tuple(words[i : i + 3])] > 1 for d in range(3)}
    deep = [x if x >= rules.min_repeat else 0 for x in longest]
    covered = {i + d for i in range(n) for d in range(deep[i])}
    lines = [x for x in (text or "").encode().split(b"\n") if x.split()]
    chars = sum(len(w.decode()) for w in words)
    symbols = sum(c in "#*$%&|<>" for c in (text or ""))
    failed = n < rules.min_words or 100 * len(rep) > rules.max_repeat_pct * n
    good = not failed and len(covered) <= rules.max_covered * n and max(deep, default=0) <= rules.max_longest
    return n, chars, symbols, len(lines) - len(set(lines)), len(rep), len(covered), max(deep, default=0), failed, good


def test_quality(spark):
    rng = random.Random(8)
    texts = [None, "", " \n", "a", "x " * 300, "é中 #| b\n\nq\nq \nq", "w\x1cv " * 9]
    for _ in range(40):
        t = [f"w{rng.randrange(rng.choice([4, 30, 500]))}" for _ in range(rng.randrange(1, 200))]
        for _ in range(rng.randrange(4)):
            a = rng.randrange(len(t))
            t[rng.randrange(len(t)) : 0] = t[a : a + rng.randrange(1, 40)]
        texts.append((" " if rng.random() < 0.8 else "\n").join(t))
    rules = quality.QualityRules(max_longest=30)
    df = docs(spark, texts).selectExpr("*", "false as kept", "1 as n_words")
    rows = {r.doc_id: r for r in quality.score_quality(df, rules).collect()}
    for i, t in enumerate(texts):
        assert tuple(rows[i])[1:] == quality_brute(t, rules), i
    assert {r.doc_id for r in quality.keep_quality(df, rules).collect()} == {i for i in rows if rows[i].kept}
    assert quality.keep_quality(df).columns == df.columns
    assert quality.score_quality(df.where("false")).count() == 0


def test_pipeline_against_brute_force(spark, tmp_path, tokenizer):
    import corpus_pipeline

    rng = random.Random(9)
    shared_lines = "\n".join(prose(rng, 15) for _ in range(6))
    texts = ["\n".join([prose(rng, 60, 5000), shared_lines if i % 4 == 0 else prose(rng, 20, 5000), prose(rng, 30, 5000)]) for i in range(30)]
    texts += [texts[1], texts[2] + " more", "too short", None, "", "again and " * 200]
    docs(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    rules = quality.QualityRules()
    rows = [(i, t) for i, t in enumerate(texts) if quality_brute(t, rules)[-1]]
    cleaned = {i: t for (i, _), (t, _) in zip(rows, passages_brute([t for _, t in rows]), strict=True)}
    ids = [i for i, _ in rows]
    _, parts = simhash_brute([cleaned[i] for i in ids])
    kept = [(ids[k], cleaned[ids[k]], f"s{ids[k] % 3}") for k in sorted(set(parts.values()))]
    size, _, taken, _ = mix_brute(kept)
    want = Counter()
    for (i, t, _), n, m in zip(kept, size, taken, strict=True):
        copies = [t] * (m // n if n else 0)
        if n and m % n:
            copies.append(" ".join(t.split()[: m % n]))
        for text in copies:
            token_ids, at = [*tokenizer.encode(text, add_special_tokens=False).ids, 0], 0
            for k in binary_lengths(len(token_ids), 1024):
                want[i, at, struct.pack(f"<{k}I", *token_ids[at : at + k])] += 1
                at += k
    assert Counter((r.doc_id, r.start, bytes(r.ids)) for r in got) == want


def test_queries_registered():
    assert [int(n[2:].split("_")[0]) for n in queries.QUERIES] == list(range(1, 14))
