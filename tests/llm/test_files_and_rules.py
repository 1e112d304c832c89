"""Token files, packing, shards, rules and licences: round trips and brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vetlake.llm import licences as L
from vetlake.llm import packing as P
from vetlake.llm import quality_rules as Q
from vetlake.llm import sharding as H
from vetlake.llm import tokens as T


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(T.default_tokenizer())
    out.encode_special_tokens = True
    return out


def plain(tokenizer, text, end):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_batches_of_long_texts_are_small(spark, tmp_path):
    from vetlake.llm.common import BATCH_BYTES, small_batches

    def sizes(batches):
        for batch in batches:
            yield pa.record_batch([pa.array([batch.nbytes])], ["n"])

    small_batches(spark)
    texts = spark.range(3000).selectExpr("repeat('abcdefgh', 1000) AS text").coalesce(1)
    got = [r["n"] for r in texts.mapInArrow(sizes, "n long").collect()]
    assert sum(got) > 2 * BATCH_BYTES and max(got) < BATCH_BYTES + (1 << 20)


PARTS = ["a", "b", "Z", "é", "ß", "中", " ", " ", "\n", "\t", ".", ",", "!", "12", "'s", " ", "　", "\r", "<|endoftext|>", "\x01", "😀", "​", "\x85", "word", " longer,"]


@pytest.mark.parametrize("seed", range(4))
def test_encoder_equals_tokenizer(tokenizer, seed):
    rng = random.Random(seed)
    for _ in range(200):
        texts = ["".join(rng.choices(PARTS, k=rng.randint(0, 20))) for _ in range(5)] + [None]
        got = [x for _, _, ids, counts in T.encoded(T.default_tokenizer(), pa.array(texts)) for x in np.split(ids, np.cumsum(counts)[:-1])]
        assert [x.tolist() for x in got] == [plain(tokenizer, t, 0)[:-1] for t in texts]


def test_encoder_forgets_and_goes_on(tokenizer, monkeypatch):
    monkeypatch.setattr(T, "CACHED", 5)
    monkeypatch.setattr(T, "LONGEST", 30)
    encode = T.Encoder(T.default_tokenizer())
    for texts in (["some words, here.\nand there"], ["x" * 100 + " y", "some words"], ["more words here, too."]):
        raw = "".join(texts).encode()
        ids, counts = encode(np.frombuffer(raw, np.uint8), np.cumsum([0, *(len(t.encode()) for t in texts)]))
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [plain(tokenizer, t, 0)[:-1] for t in texts]


def test_token_files_round_trip(spark, tokenizer, odd_docs, no_docs):
    rows = T.token_files(odd_docs).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("c")).collect()
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.select("doc_id", "text").collect()]
    want = sorted(((i is None, i or 0, t or ""), plain(tokenizer, t, 2)) for i, t in docs)
    start, out = 0, []
    for (none, i, _), ids in want:
        out.append((None if none else i, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(map(tuple, rows), key=lambda r: r[1]) == out
    assert T.token_files(no_docs).count() == 0


def test_reader_maps_files(spark, tmp_path, tokenizer):
    df = spark.createDataFrame([(3, "three"), (1, "one two"), (2, None)], "doc_id long, text string")
    manifest = T.write_token_files(df.coalesce(1), f"file://{tmp_path}/f", T.default_tokenizer(), 2)
    seen = {}
    for name, docs, _, base in manifest:
        files = T.Reader(f"file://{tmp_path}/f", name)
        assert isinstance(files.ids, np.memmap) and len(files) == docs and files.ids.dtype == np.dtype("<u2")
        for i in range(docs):
            seen[int(files.keys[i])] = (base + int(files.offsets[i]), files[i].tolist())
    assert seen == {1: (0, plain(tokenizer, "one two", 2)), 2: (len(seen[1][1]), [2]), 3: (len(seen[1][1]) + 1, plain(tokenizer, "three", 2))}


def test_packing_holds_every_id_once(spark, tokenizer, odd_docs, no_docs):
    rng = random.Random(1)
    more = [(100 + i, " ".join(rng.choices(["alpha", "beta", "gamma"], k=rng.choice([0, 3, 200, 255, 256, 900, 3000])))) for i in range(150)]
    docs = odd_docs.select("doc_id", "text").unionAll(spark.createDataFrame(more, "doc_id long, text string")).repartition(3)
    rows = P.pack(docs).collect()
    ids = {i: plain(tokenizer, t, 1) for i, t in more}
    cover = {}
    sequences = {}
    for r in rows:
        piece = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(piece) == r["length"]
        if r["doc_id"] in ids:
            assert piece == ids[r["doc_id"]][r["start"] : r["start"] + r["length"]] and r["doc_tokens"] == len(ids[r["doc_id"]])
            cover.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], r["tier"]))
    for i, spans in cover.items():
        at = 0
        for start, length in sorted(spans):
            assert start == at
            at += length
        assert at == len(ids[i])
    assert cover.keys() == ids.keys()
    padded = []
    for spans in sequences.values():
        at = 0
        for offset, length, tier in sorted(spans):
            assert offset == at
            at += length
        assert at <= tier
        if at != tier:
            padded.append(at)
    assert len(padded) <= 1
    wanted = sum(len(plain(tokenizer, t, 1)) for _, t in ((r["doc_id"], r["text"]) for r in docs.collect()))
    assert sum(r["length"] for r in rows) == wanted
    assert P.pack(no_docs).count() == 0


@pytest.mark.parametrize("together", [1024, 4])
def test_many_partitions_pad_one_sequence(spark, tokenizer, monkeypatch, together):
    monkeypatch.setattr(P, "TOGETHER", together)
    texts = [(i, " ".join(["alpha"] * (2200 + i % 7))) for i in range(200)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(50)
    rows = P.pack(docs).collect()
    size, pieces = Counter(), {}
    for r in rows:
        size[r["sequence_id"]] += r["length"]
        pieces.setdefault(r["doc_id"], []).append((r["start"], np.frombuffer(r["ids"], "<u4").tolist()))
        assert len(np.frombuffer(r["ids"], "<u4")) == r["length"]
    assert {i: [x for _, ids in sorted(p) for x in ids] for i, p in pieces.items()} == {i: plain(tokenizer, t, 1) for i, t in texts}
    assert sum(n not in P.TIERS for n in size.values()) <= 1 and max(size.values()) <= 2048
    for s in size:
        at = 0
        for offset, length in sorted((r["offset"], r["length"]) for r in rows if r["sequence_id"] == s):
            assert offset == at
            at += length
    groups = Counter()
    for s, n in size.items():
        groups[next(r["step_group"] for r in rows if r["sequence_id"] == s)] += n
    assert max(groups.values()) <= P.STEP + 2048


@pytest.mark.parametrize("seed", range(5))
def test_packer_routes_and_fills(seed):
    rng = random.Random(seed)
    packer = P.Packer((4, 8, 16))
    pieces = [(rng.randint(1, 16), d, 0) for d in range(60)]
    out, left = packer.pack(pieces, True)
    assert sum(p[0] for p in left) < 16 and all(sum(p[0] for p in w) in (4, 8, 16) for w in out)
    spans = {}
    for size, doc, start in [p for w in out for p in w] + left:
        spans.setdefault(doc, []).append((start, size))
    for size, doc, _ in pieces:  # each id in exactly one piece
        at = 0
        for start, n in sorted(spans[doc]):
            assert start == at
            at += n
        assert at == size
    for w in out:  # only the last piece of a window is cut off, and only pieces that no window takes whole
        assert all(start + n == next(s for s, d, _ in pieces if d == doc) for n, doc, start in w[:-1])


def test_dealt_groups_are_even():
    sizes = [2048] * 40 + [1024] * 30 + [256] * 20
    groups = P.deal(sizes, 8192)
    sums = [sum(s for s, g in zip(sizes, groups) if g == k) for k in set(groups)]
    assert max(sums) - min(sums) <= 1024


def shards(rows, n):
    for s in range(n):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    return [sum(r["size"] for r in rows if r["shard"] == s) for s in range(n)]


def test_shards_have_equal_bytes(spark, odd_docs, no_docs):
    rng = random.Random(2)
    texts = ["x" * rng.choice([0, 1, 10, 100, 5000]) + str(rng.random()) for _ in range(700)] + ["hot group of copies " * 10] * 500
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    rows = H.shard(df, 8).collect()
    sums = shards(rows, 8)
    assert sum(sums) == sum(len(t) + 1 for t in texts) and max(sums) - min(sums) <= 2 * 5020
    assert {r["doc_id"]: r["text_crc32"] for r in rows} == {i: zlib.crc32(t.encode()) for i, t in enumerate(texts)}
    odd = H.shard(odd_docs, 2).collect()
    shards(odd, 2)
    assert sorted((str(r["doc_id"]), r["size"]) for r in odd) == sorted((str(r["doc_id"]), len((r["text"] or "").encode()) + 1) for r in odd_docs.select("doc_id", "text").collect())
    assert H.shard(no_docs, 8).count() == 0


def measured(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    again = {p for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for p in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n, sym = len(w), len(re.findall(r"[#*$%&|<>]", text))
    return n, sum(map(len, w)), sym, len(lines) - len(set(lines)), len(again), n < 20 or 100 * len(again) > 30 * n


def test_rules_equal_brute_force(spark, odd_docs, no_docs):
    rng = random.Random(4)
    words = ["a", "bb", "#c", "d|", "é", "中文", "e!"]
    texts = [rng.choice([" ", "\n", "  ", "\t"]).join(rng.choices(words[: rng.randint(1, 7)], k=rng.choice([0, 5, 8, 19, 20, 60, 200]))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").unionAll(odd_docs.select("doc_id", "text"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    rows = Q.apply_policy(Q.ledger(df)).select("doc_id", *names, "kept").collect()
    want = sorted(((str(r["doc_id"]), *measured(r["text"])) for r in df.collect()))
    assert sorted(((str(r["doc_id"]), *(r[n] for n in names)) for r in rows)) == want
    assert not any(r["kept"] and r["base_failed"] for r in rows)
    assert Q.ledger(no_docs).count() == 0


def test_ablations_count_what_a_rule_alone_holds_back(spark):
    rows = spark.createDataFrame([(0,), (1,), (1,), (3,), (4,)], "failed long")
    got = {r["rule"]: (r["n_failed"], r["n_only"]) for r in Q.ablations(rows, "v2").collect()}
    assert got["too_few_words"] == (3, 2) and got["repeated_windows"] == (1, 0) and got["symbols"] == (1, 1)
    assert [r["kept"] for r in Q.apply_policy(rows, "base").collect()] == [True, False, False, False, True]


def test_licences_and_inheritance(spark, odd_docs):
    body = "plain words of a text\n" * 3
    files = [
        ("LICENSE", "Released under the MIT License."),
        ("src/a.py", body),
        ("src/b.py", body + "Licensed under the Apache License, Version 2.0.\n" + body),
        ("src/lib/COPYING", "This work is licensed under the GNU General Public License, version 3."),
        ("src/lib/deep/er/x.py", body),
        ("src/lib2/y.py", None),
        ("docs/NOTICE", "nothing said"),
        (None, body),
        ("src/lib/deep/z.py", "under the sun, version of the work"),
        ("q", ""),
    ]
    rows = {r["path"]: r for r in L.scan(spark.createDataFrame([(*f, 1) for f in files], "path string, text string, own_licence int")).collect()}
    got = {p: (r["own_licence"], r["licence"], r["licence_dir"]) for p, r in rows.items()}
    assert got == {
        "LICENSE": ("MIT", "MIT", None),
        "src/a.py": (None, "MIT", ""),
        "src/b.py": ("Apache-2.0", "Apache-2.0", None),
        "src/lib/COPYING": ("GPL-3.0", "GPL-3.0", None),
        "src/lib/deep/er/x.py": (None, "GPL-3.0", "src/lib"),
        "src/lib2/y.py": (None, "MIT", ""),
        "docs/NOTICE": (None, "MIT", ""),
        None: (None, None, None),
        "src/lib/deep/z.py": (None, "GPL-3.0", "src/lib"),
        "q": (None, "MIT", ""),
    }
    assert rows["LICENSE"]["similarity"] > 0.99
    odd = odd_docs.withColumn("path", F.concat(F.lit("d/"), F.col("doc_id")))
    assert L.scan(odd).count() == odd_docs.count()
    assert L.scan(odd.where("false")).count() == 0
