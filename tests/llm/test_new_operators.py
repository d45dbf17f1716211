"""Token records, Merkle manifest and source divergence against brute force; damage, tampering, nulls, ties, odd columns, empty tables."""

import gzip
import hashlib
import os
import random
import re
import struct
import zlib
from collections import Counter

import duckdb
import pytest
from test_llm import BPE, HARD, docs, fuzz, prose, record

from tickloom.llm import divergence, merkle, queries, shared, token_records, warc


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BPE)


def packed(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


def test_frames():
    data = token_records.frame(b"abc") + token_records.frame(b"")
    at, payload = token_records.unframe(data)
    assert bytes(payload) == b"abc" and token_records.unframe(data, at) == (len(data), b"")
    for i in range(at):
        with pytest.raises(ValueError):
            token_records.unframe(data[:i] + bytes([data[i] ^ 1]) + data[i + 1 : at])
    with pytest.raises(ValueError):
        token_records.unframe(data[: at - 1])


def test_op11_query(spark, tmp_path, tokenizer):
    rng = random.Random(4)
    texts = HARD + fuzz(300, 9) + [prose(rng, 30) for _ in range(200)]
    ids = rng.sample(range(-50, 5000), len(texts))
    docs(spark, texts, ids=ids).repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(queries.op11_token_records(spark, str(tmp_path)).collect())
    before = 0
    for r, (key, text) in zip(got, sorted(zip(ids, texts, strict=True)), strict=True):
        own = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (key, before, len(own), zlib.crc32(packed(own)))
        before += len(own)


def test_records_of_odd_rows(spark, tokenizer):
    rows = [(None, "x y"), (None, None), (3, "same"), (3, "same"), (3, "other"), (-1, "word " * 200_000), (2**63 - 1, "")]
    df = spark.createDataFrame(rows, "`a.b` long, text string").selectExpr("*", "1 as id", "2 as h", "3 as r", "4 as t")
    root = shared.shared_path(spark, "t")
    made = token_records.write_records(df, BPE, root, roll_bytes=64, id_col="a.b").collect()
    assert sum(r.records for r in made) == len(rows) and len(made) >= 6  # rolled
    found = token_records.read_records(spark, root).orderBy("shard", "place").collect()
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r.id for r in found] == [k for k, _ in want]
    texts = sorted(packed(tokenizer.encode(t or "", add_special_tokens=False).ids) for _, t in rows)
    assert sorted(bytes(r.ids) for r in found) == texts and all(r.ids_crc32 == zlib.crc32(r.ids) for r in found)
    index = {(r.shard, r.place): r for r in token_records.read_index(spark, root).collect()}
    assert {(r.shard, r.place): (r.offset, r.n_tokens, r.start) for r in found} == {k: (r.offset, r.tokens, r.start) for k, r in index.items()}
    for seed in (1, 2):
        drawn = token_records.shuffled_records(spark, root, seed)
        again = [(r.turn, r.id) for r in token_records.shuffled_records(spark, root, seed).collect()]
        assert [(r.turn, r.id) for r in drawn.collect()] == again == sorted(again, key=lambda r: r[0])
        assert sorted(bytes(r.ids) for r in drawn.collect()) == texts
    empty = shared.shared_path(spark, "t")
    assert token_records.write_records(df.where("false"), BPE, empty, id_col="a.b").count() == token_records.record_starts(spark, empty).count() == 0


def test_damaged_records_are_named(spark):
    root = shared.shared_path(spark, "t")
    token_records.write_records(docs(spark, ["some words here"] * 3), BPE, root).collect()
    path = root.removeprefix("file:")
    name = sorted(f for f in os.listdir(path) if f.endswith(".rec"))[0]
    with open(f"{path}/{name}", "r+b") as f:
        f.seek(-6, 2)
        byte = f.read(1)
        f.seek(-6, 2)
        f.write(bytes([byte[0] ^ 4]))
    with pytest.raises(Exception, match="shard-.*payload is damaged"):
        token_records.read_records(spark, root).collect()


def joined(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(doc_id, text, lang, source, n_chars):
    return joined("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text))


def tree_of(nodes, arity=16):
    """(root, (place, siblings) of each leaf level by level)"""
    paths, members = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        above, held = [], []
        for a in range(0, len(nodes), arity):
            run = nodes[a : a + arity]
            for k in range(len(run)):
                for i in members[a + k]:
                    paths[i].append((k, run[:k] + run[k + 1 :]))
            above.append(joined(run))
            held.append([i for m in members[a : a + arity] for i in m])
        nodes, members = above, held
    return nodes[0], paths


def manifest_brute(rows, tampered=lambda r: r, arity=16):
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    own = [sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(*r))) for s in order]
    trees = [tree_of([leaf_of(*r) for r in rs], arity) for rs in own]
    root, tops = tree_of([t[0] for t in trees], arity)
    out = []
    for rs, (subroot, paths), top in zip(own, trees, tops, strict=True):
        for r, path in zip(rs, paths, strict=True):
            x = leaf_of(*tampered(r))
            for place, siblings in path + top:
                x = joined([*siblings[:place], x, *siblings[place:]])
            out.append((r[0], leaf_of(*r), subroot, root, joined(d for _, s in path + top for d in s), x, x == root))
    return out


def lower_az(r):
    if r[0] is None or r[1] is None or zlib.crc32(str(r[0]).encode()) % 5:
        return r
    return (r[0], "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[1]), *r[2:])


def merkle_rows(sizes, seed=3):
    rng, rows = random.Random(seed), []
    for source, n in sizes.items():
        rows += [(rng.randrange(10**6), rng.choice([None, "", "Ab É", prose(rng, 5).title()]), rng.choice([None, "en"]), source, rng.choice([None, 7])) for _ in range(n)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(
    "sizes",
    [{"a": 1}, {None: 16}, {"a": 17}, {"a": 1, "b": 1}, {"b": 300, None: 1, "a": 16, "é": 273, "": 2}, {f"s{i}": 1 + i % 3 for i in range(40)}],
    ids=str,
)
def test_op12_query(spark, tmp_path, sizes):
    rows = merkle_rows(sizes)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, queries.op12_merkle(spark, str(tmp_path)).collect()))
    assert got == sorted(manifest_brute(rows, lower_az))
    assert len(rows) < 40 or not all(r[-1] for r in got)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(db.execute(queries.ORACLE_SQL["op12_merkle"]).fetchall()) == got


def test_merkle_of_odd_rows(spark, monkeypatch):
    rows = merkle_rows({"a": 40, "b": 9})
    rows = [(None, *r[1:]) for r in rows[:9]] + [rows[9]] * 6 + rows[15:]
    df = spark.createDataFrame(rows, "id long, text string, lang string, source string, n_chars long")
    leaf = merkle.record_digest(*(df[c] for c in ("id", "source", "lang", "n_chars", "text")))
    leaves = df.select("id", "source", leaf.alias("leaf"), df["text"].alias("s"), df["text"].alias("tree"), df["text"].alias("spread"), df["text"].alias("a.b"))
    for arity, most in ((2, 1 << 18), (3, 4)):
        monkeypatch.setattr(merkle, "OPEN_CHILDREN", most)
        found, held = merkle.merkle_manifest(leaves, arity)
        got = merkle.fold_proofs(found, arity=arity)
        assert {"s", "tree", "spread", "a.b"} < set(got.columns)
        got = got.collect()
        shared.drop_cuts(*held)
        want = manifest_brute(rows, arity=arity)
        key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
        assert sorted(((r.id, *(bytes(x).hex() for x in (r.leaf, r.subroot, r.root, r.proof_sha256, r.folded)), True) for r in got), key=key) == sorted(want, key=key)
    found, held = merkle.merkle_manifest(leaves.where("false"))
    assert found.count() == 0
    with pytest.raises(ValueError):
        merkle.fold(b"0" * 32, [], b"1" * 32)


def divergence_brute(rows):
    """Rows (text, lang, source) to (lang, source, part, item, value, rank)."""
    words = lambda t: ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t)]
    docs = [(lang or "", source or "", words(text or "")) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        held = Counter(w for d in own for w in set(d[2]))
        kept = sorted(w for w, n in held.items() if n >= 3)
        among = Counter(w for d in own for w in d[2] if held[w] >= 3)
        counts = {s: Counter(w for d in own if d[1] == s for w in d[2] if held[w] >= 3) for s in {d[1] for d in own}}

        def share(c, w, v=len(kept)):
            return 1 + 10**9 * (c[w] + 1) // (c.total() + v)

        far = lambda p, q: (p - q) ** 2 // q
        for s, c in counts.items():
            pairs = [(sum(far(share(c, w), share(d, w)) for w in kept), t) for t, d in counts.items() if t != s]
            terms = [(far(share(c, w), share(among, w)), w) for w in kept if c[w] and share(c, w) > share(among, w)]
            for part, found, most in (("pair", pairs, None), ("term", terms, 200)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(found[:most])]
    return out


def test_op13_query(spark, tmp_path):
    rng = random.Random(8)
    rows = [(prose(rng, 40, 900).replace("w", rng.choice("wWé")).translate({ord(str(i)): x for i, x in enumerate("abcdefghij")}), rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", "c", None, "é"])) for _ in range(500)]
    rows += [("x " * 4000, "en", "a"), (None, "fr", "a"), ("", "fr", "b"), ("only Two", "fr", "c"), ("only two", "fr", "c"), ("1 2 _ [] `", "it", None)]
    rows += [("Éa ÉA éa a\x00b c\x7fd e@f 中文 x", "es", s) for s in ("a", "a", "b", "b")] + [rows[0]] * 5
    df = spark.createDataFrame([(i % 7, *r, 1) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    df.repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op13_divergence(spark, str(tmp_path)).select("lang", "source", "part", "item", "value", "rank").collect()
    want = sorted(divergence_brute(rows))
    assert sorted(map(tuple, got)) == want and {r[5] for r in want} >= {200} and ("fr", "a", "pair", "b", 0, 1) in want
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    made = db.execute(queries.ORACLE_SQL["op13_divergence"])
    names = [c[0] for c in made.description]
    assert sorted(tuple(r[names.index(c)] for c in ("lang", "source", "part", "item", "value", "rank")) for r in made.fetchall()) == want


def test_divergence_of_odd_columns(spark):
    df = spark.createDataFrame([("a b", "en", "x", 1), ("a c", "en", "x", 2), ("a", "en", "y", 3)], "`t.t` string, `l l` string, `n` string, term int").selectExpr("*", "1 as value", "2 as salt", "3 as source")
    got = divergence.source_divergence(df, lang_col="l l", source_col="n", text_col="t.t")
    assert sorted(map(tuple, got.collect())) == sorted(divergence_brute([("a b", "en", "x"), ("a c", "en", "x"), ("a", "en", "y")]))
    assert divergence.source_divergence(df.where("false"), lang_col="l l", source_col="n", text_col="t.t").count() == 0


def test_salvage_takes_no_record_out_of_a_payload():
    quoted = record(99, b"never written")
    for wrap in (bytes, gzip.compress):
        bad = bytearray(record(1, b"a page about archives\r\n\r\n" + quoted + b"tail"))
        bad[bad.index(b"tail") + 1] ^= 1
        data = b"".join(map(wrap, (record(0, b"x"), bytes(bad), record(2, b"y"))))
        found = list(warc.salvage(data))
        assert [w[0]["x-page-id"] for kind, *_, w in found if kind == "record"] == ["0", "2"]
        assert [(kind, why) for kind, *_, why in found if kind == "gap"] == [("gap", "block digest differs")]
        assert sum(b - a for _, a, b, _ in found) == len(data)
    cut = record(1, b"p" * 50)[:-30] + record(2, b"z")  # its length leads nowhere: the next version line is searched for
    assert [w[0]["x-page-id"] for kind, *_, w in warc.salvage(cut) if kind == "record"] == ["2"]
