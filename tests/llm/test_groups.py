"""Near-duplicates, repeated substrings, top-k, classifier, archives, token files: brute force, round trips, edge rows."""

from __future__ import annotations

import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from helpers import LONG, PLAIN, docs, odd_rows, with_clashes
from hypothesis import given, settings, strategies as st
from pyarrow import fs
from pyspark.sql import functions as F

from chartloom.llm import cotrain, covertree, mixcoder, neardup, suffixdedup, tokenfile, warc
from chartloom.llm.components import components
from chartloom.session import shared_dir

# -- near-duplicates


def brute_components(rows, size, percent):
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        sets[d] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d), find(d) == d) for d in ids}


def near_rows(seed, families, members, edits):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 5)))
    rows = []
    for _ in range(families):
        base = [word() for _ in range(rng.randint(30, 150))]
        for _ in range(members):
            copy = list(base)
            for _ in range(rng.randint(0, edits)):
                copy[rng.randrange(len(copy))] = word()
            rows.append((len(rows) * 3 + 1, " ".join(copy)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("tile", [4, 64])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(neardup, "SMALL", tile)
    monkeypatch.setattr(neardup, "TILE", tile // 2)  # 2: cells of many tiles
    rows = near_rows(tile, 6, 18, 5) + [(1000, None), (1001, ""), (1002, " \t"), (1003, "A b"), (1004, "a  B"), (1005, "a b c"), (1006, LONG), (1007, LONG + "end")]
    got = {r.doc_id: tuple(r)[1:] for r in neardup.near_duplicates(with_clashes(docs(spark, rows)), size=3, percent=85).collect()}
    assert got == brute_components(rows, 3, 85)


@pytest.mark.parametrize("again", [lambda k: 1, lambda k: k > 0])
def test_near_duplicates_of_repeated_rows(spark, again):
    rows = near_rows(5, 40, 3, 4)
    first = {}
    for d, _ in sorted(rows):
        first[d] = d // 3 % 3  # place in its family
    frame = docs(spark, rows + [r for r in rows if again(first[r[0]])])
    got = {r.doc_id: tuple(r)[1:] for r in neardup.near_duplicates(frame, size=3, percent=85).collect()}
    assert got == brute_components(rows, 3, 85)
    m = neardup.collections_for(85)
    keys = neardup.table_keys(neardup.sketches(frame.select("doc_id", "text"), 3, m).filter("n > 0"), m)
    assert keys.count() == keys.distinct().count() > 0


def test_near_duplicate_edges(spark):
    frame = with_clashes(docs(spark, odd_rows()))
    got = sorted(tuple(r) for r in neardup.near_duplicates(frame).collect())
    assert [g[0] for g in got] == [1, 2, 3, 4, 5, 5, 7, 8] and {g[2] for g in got if g[0] in (1, 5)} == {1}
    left = neardup.drop_near_duplicates(frame)
    assert left.columns == frame.columns and sorted(r.doc_id or 0 for r in left.collect()) == [0, 1, 2, 3, 4, 7, 8]
    assert neardup.near_duplicates(frame.limit(0)).count() == 0


def test_sub_keys_keep_the_stated_miss_rate():
    for percent in (80, 85, 90):
        m = neardup.collections_for(percent)
        assert 2 * (1 - (percent / 100) ** neardup.ROWS) ** m <= neardup.MISS


def test_components(spark):
    rng = random.Random(2)
    chain = [(k, k + 1) for k in range(40)]
    star = [(100, k) for k in range(101, 160)]
    mess = [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    edges = chain + star + mess + chain[:3]
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == root
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- repeated substrings


def brute_removed(rows):
    seen, out = set(), {}
    for d, t in sorted(rows):
        data = (t or "").encode()
        own = [data[k : k + 50] for k in range(len(data) - 49)]
        cover = bytearray(len(data))
        for k, w in enumerate(own):
            if w in seen:
                cover[k : k + 50] = b"\1" * 50
        seen.update(own)
        spans = sum(1 for k in range(len(data)) if cover[k] and not (k and cover[k - 1]))
        out[d] = (len(data), sum(cover), spans, bytes(c for c, z in zip(data, cover) if not z))
    return out


@pytest.mark.parametrize("most", [1, 5000])
def test_repeated_substrings_equal_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(suffixdedup, "MOST_CLASSES", most)  # 1: every shared gram goes by aggregates
    rng = random.Random(9)
    passages = ["".join(rng.choice("abé ") for _ in range(rng.randint(20, 200))) for _ in range(25)]
    rows = []
    for d in range(60):
        parts = [rng.choice(passages)[rng.randint(0, 30) :] if rng.random() < 0.6 else "".join(rng.choice("xyz") for _ in range(rng.randint(0, 90))) for _ in range(6)]
        rows.append((d * 7 % 61, "".join(parts)))
    rows += [(100, "a" * 300), (101, "a" * 49), (102, "a" * 50), (103, None), (104, ""), (105, "ab" * 100), (106, LONG), (107, LONG[3:])]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixdedup.dedup_substrings(with_clashes(docs(spark, rows))).collect()}
    assert got == brute_removed(rows)


def test_substring_edges(spark):
    got = suffixdedup.dedup_substrings(with_clashes(docs(spark, odd_rows())))
    rows = sorted((r.doc_id or 0, r.n_removed == r.n_bytes) for r in got.collect() if r.n_bytes)
    assert rows == [(0, False), (1, False), (4, False), (5, True), (5, True), (7, False), (8, False)]
    assert suffixdedup.dedup_substrings(docs(spark, odd_rows()).limit(0)).count() == 0


# -- top-k


def brute_top(vectors, queries, k):
    fine = {i: np.array([np.floor(256 * float(np.float32(x))) for x in v]) for i, v in vectors if v is not None and all(x is not None and np.isfinite(x) for x in v)}
    dim = max((len(v) for v in fine.values()), default=0)
    fine = {i: np.pad(v, (0, dim - len(v))) for i, v in fine.items()}
    out = set()
    for q in queries:
        if q in fine:
            best = sorted((-int(fine[q] @ v), i) for i, v in fine.items() if i != q)[:k]
            out |= {(q, rank, i, -s) for rank, (s, i) in enumerate(best, 1)}
    return out


@pytest.mark.parametrize("block", [7, 4096])
def test_top_k_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(covertree, "BLOCK_ROWS", block)
    rng = np.random.default_rng(block)
    centres = rng.normal(size=(5, 6))
    rows = [(k, (centres[k % 5] + rng.normal(size=6) * 0.2).tolist()) for k in range(200)]
    rows += [(k, [0.5] * 6) for k in range(200, 230)] + [(300, None), (301, [1.0, None] * 3), (302, [float("nan")] * 6), (303, [float("inf")] * 6), (304, [1.0, 2.0]), (305, [])]
    frame = with_clashes(spark.createDataFrame([(i, v) for i, v in rows], "vec_id long, embedding array<float>"))
    asked = frame.filter("vec_id % 10 = 0")
    monkeypatch.setattr(covertree.packed, "__defaults__", (block,))
    for query_rows in (8192, 6):
        got = [tuple(r) for r in covertree.top_k(asked, frame, 5, query_rows=query_rows).collect()]
        assert len(got) == len(set(got)) and set(got) == brute_top(rows, [i for i, _ in rows if i % 10 == 0], 5)
    few = frame.filter("vec_id < 3")
    assert covertree.top_k(few, few, 5).count() == 6
    assert covertree.top_k(frame.limit(0), frame.limit(0), 5).count() == 0


def test_top_k_of_repeated_rows(spark):
    same = [(i, [0.5, 1.0]) for i in (1, 2, 3, 4)]
    rows = (same + [(9, [0.25, 0.25])]) * 2
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1)
    got = sorted(tuple(r) for r in covertree.top_k(frame.filter("vec_id = 1"), frame, 5).collect())
    assert [(g[1], g[2]) for g in got] == [(1, 2), (2, 2), (3, 3), (4, 3), (5, 4)] and len({g[3] for g in got}) == 1


def test_cover_tree_keeps_its_invariants_and_prunes():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 3)) * 50
    x = np.floor(centres[rng.integers(0, 30, 1500)] + rng.normal(size=(1500, 3)))
    t = covertree.build(x)
    for node, kids in enumerate(t.children):
        rows = t.order[t.start[node] : t.stop[node]]
        assert np.sqrt(((x[rows] - x[t.centre[node]]) ** 2).sum(1)).max() <= t.radius[node] + 1e-9
        if len(kids):
            c = x[t.centre[kids]]
            assert t.centre[kids[0]] == t.centre[node] and t.start[kids[0]] == t.start[node] and t.stop[kids[-1]] == t.stop[node]
            apart = np.sqrt(((c[:, None] - c[None]) ** 2).sum(-1)) + np.eye(len(c)) * 1e9
            assert apart.min() > t.radius[node] / 2 >= t.radius[kids].max() - 1e-9
    q = x[:40]
    best = covertree.Best(40, 5)
    done = covertree.search(q, np.arange(40), covertree.build(q), x, np.arange(1500), t, best)
    scores = q @ x.T
    scores[np.arange(40), np.arange(40)] = -np.inf
    assert (np.sort(-best.score, 1) == np.sort(-scores, 1)[:, :5]).all() and done < 40 * 1500


# -- classifier


def test_co_training_learns_from_its_other_view():
    rng = np.random.default_rng(4)
    n = 3000
    truth = rng.integers(0, 2, n)
    text = (truth[:, None] * 2 - 1 + rng.normal(size=(n, 4))).astype(np.float32)
    meta = (truth[:, None] * 2 - 1 + rng.normal(size=(n, 3)) * 1.5).astype(np.float32)
    label = np.where(np.arange(n) < 60, truth, -1)
    model = cotrain.co_train(text, meta, label, np.arange(n) % 5)
    a, b, both = model.score(text, meta)
    right = lambda p: ((p >= 0.5) == truth)[60:].mean()
    assert model.handed > 100 and right(both) >= max(right(a), right(b)) - 0.005 and right(both) > 0.97


def test_every_unlabelled_row_takes_part(spark):
    rng = np.random.default_rng(6)
    n = 20_000  # the former pool held 6,000 rows, the former rounds handed over 2,000 labels at most
    truth = rng.integers(0, 2, n)
    text = (truth[:, None] * 2 - 1 + rng.normal(size=(n, 4)) * 0.5).astype(np.float32)
    model = cotrain.co_train(text, text[:, :3], np.where(np.arange(n) < 600, truth, -1), np.arange(n) % 5)
    assert model.handed > n  # by two views
    rows = odd_rows() + [(k, PLAIN if k % 2 else "BAD!! " * 30, None) for k in range(30, 500)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(30, 400)], "doc_id long, quality int")
    stored = cotrain.feature_table(docs(spark, rows), labels)
    held = sum(zlib.crc32(str(k).encode()) % 5 == 0 for k in range(30, 400))
    assert stored.count() == len(rows) - held and stored.filter("label >= 0").count() == 370 - held
    parts = cotrain._rows(stored.toArrow())
    here, there = cotrain.co_train(*parts), cotrain.train(docs(spark, rows), labels)
    assert here.handed == there.handed > 0 and np.allclose(here.text.weights, there.text.weights, atol=1e-2)


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = cotrain.op1_quality_classifier(spark, sf).collect()
    held = [r for r in rows if r.doc_id in labels and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(rows) == 1000 and all(0 <= r.score <= 1 for r in rows)
    assert np.mean([r.keep == (labels[r.doc_id] == 1) for r in held]) > 0.95


def test_classifier_edges(spark):
    frame = with_clashes(docs(spark, odd_rows() + [(k, PLAIN if k % 2 else "BAD!! " * 30, None) for k in range(30, 80)]))
    labels = spark.createDataFrame([(k, k % 2) for k in range(30, 80)] + [(1, None), (31, 1)], "doc_id long, quality int")
    got = {r.doc_id: r.keep for r in cotrain.score(frame, cotrain.train(frame, labels)).collect()}
    assert got[1] and not got[32] and {2, 3, None} <= set(got)
    for some, prior in ((labels.limit(0), 0.5), (labels.filter("quality = 1"), 1.0)):
        assert {r.score for r in cotrain.score(frame, cotrain.train(frame, some)).collect()} == {prior}
    assert cotrain.score(frame.limit(0), cotrain.train(frame.limit(0), labels)).count() == 0


# -- archives


def test_archive_round_trip_and_pushdown(spark):
    big = "<p>" + "ü" * 300_000
    rows = [(5, "http://a/\r\nX: y", PLAIN), (3, None, PLAIN), (9, "http://b", PLAIN), (1, "http://c", "short"), (2, "http://c", "short"), (4, "u", None), (6, "u", ""), (7, "u", big), (8, "v", big), (None, "w", PLAIN), (3, None, PLAIN)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(0)).withColumn("first", F.lit(1))
    path = f"{shared_dir(spark)}/archive"
    warc.write_archive(warc.page_records(pages), path)
    back = warc.read_archive(spark, path)
    got = sorted((r.record_id or "", r.record_type, r.refers_to, r.target_uri, r.http_length, None if r.payload is None else r.payload.decode()) for r in back.filter("record_type IN ('response', 'revisit')").collect())
    want = []
    for i, url, html in rows:
        html = html or ""
        first = min(j for j, _, h in rows if j is not None and (h or "") == html) if len(html.encode()) >= 100 else i
        kind = "response" if i == first else "revisit"
        url = url and "".join(f"%{ord(c):02X}" if c < " " else c for c in url)
        want.append((f"urn:page:{i}" if i else "", kind, None if kind == "response" else f"urn:page:{first}", url, len(html.encode()), (html if kind == "response" else None)))
    assert got == sorted(want, key=lambda r: (r[0], r[1]))
    heads = warc.read_archive(spark, path, payload=False).filter("record_type = 'revisit' AND target_uri = 'v'")
    assert [(r.record_id, r.payload) for r in heads.collect()] == [("urn:page:8", None)]
    empty = f"{shared_dir(spark)}/empty"
    warc.write_archive(warc.page_records(pages.limit(0)), empty)
    assert warc.read_archive(spark, empty).filter("record_type = 'response'").count() == 0


def test_unwanted_payloads_are_not_decoded(tmp_path):
    rows = [{"record_id": f"urn:page:{k}", "record_type": "response", "target_uri": "u", "refers_to": None, "payload_digest": "0", "http_length": 50_000, "payload": bytes(np.random.default_rng(k).integers(0, 256, 50_000, dtype=np.uint8))} for k in range(20)]
    for name, pack in (("a.warc.gz", warc.member), ("b.warc", lambda b: b)):
        (tmp_path / name).write_bytes(b"".join(pack(warc.record(r)) for r in rows))
        with fs.LocalFileSystem().open_input_file(str(tmp_path / name)) as file:
            archive = warc.Archive(file)
            some = list(archive.records(lambda h: True if h["warc-record-id"] == "<urn:page:7>" else None))
        assert len(some) == 1 and some[0][1].endswith(rows[7]["payload"]) and archive.decoded < 60_000


def test_foreign_gzip_members_are_read(tmp_path):
    import gzip

    row = {"record_id": "urn:x", "record_type": "response", "target_uri": "u", "refers_to": None, "payload_digest": "0", "http_length": 3, "payload": b"abc"}
    (tmp_path / "f.warc.gz").write_bytes(gzip.compress(warc.info_record()) + gzip.compress(warc.record(row)) * 3)
    with fs.LocalFileSystem().open_input_file(str(tmp_path / "f.warc.gz")) as file:
        assert [h["warc-type"] for h, _ in warc.Archive(file).records(lambda h: False)] == ["warcinfo"] + ["response"] * 3


def damaged_archives():
    """Name, bytes, ids read whole, bytes passed over (None: the digest differs), for both kinds of archive."""
    import hashlib

    def make(k, digest=None):
        body = np.random.default_rng(k).integers(97, 122, 3000, dtype=np.uint8).tobytes()
        return warc.record({"record_id": f"urn:page:{k}", "record_type": "response", "target_uri": "u", "refers_to": None, "payload_digest": digest or hashlib.sha256(body).hexdigest(), "http_length": 3000, "payload": body})

    for end, pack in ((".warc.gz", warc.member), (".warc", lambda b: b)):
        parts = [pack(make(k)) for k in range(4)]
        stray = b"\0oops"
        yield "stray" + end, parts[0] + stray + b"".join(parts[1:]), [0, 1, 2, 3], len(stray) + (4 if end == ".warc" else 0)
        yield "cut" + end, b"".join(parts)[:-50], [0, 1, 2], len(parts[3]) - 50 + (4 if end == ".warc" else 0)
        yield "digest" + end, parts[0] + pack(make(1, "0" * 64)) + parts[2] + parts[3], [0, 2, 3], None
    flipped = bytearray(parts[1])
    flipped[-1000] ^= 1
    yield "flipped.warc", parts[0] + bytes(flipped) + parts[2], [0, 2], None
    zipped = [warc.member(make(k)) for k in range(3)]
    flipped = bytearray(zipped[1])
    flipped[200] ^= 255
    yield "flipped.warc.gz", zipped[0] + bytes(flipped) + zipped[2], [0, 2], len(flipped)


def test_damage_is_an_error_or_marked(spark, tmp_path):
    for name, data, whole, passed in damaged_archives():
        folder = tmp_path / name
        folder.mkdir()
        (folder / name).write_bytes(data)
        with pytest.raises(Exception, match="damaged record at byte|differs from its digest"):
            warc.read_archive(spark, str(folder)).collect()
        marked = warc.read_archive(spark, str(folder), damaged="mark")
        rows = marked.collect()
        assert sorted(r.record_id for r in rows if r.record_type == "response") == [f"urn:page:{k}" for k in whole], name
        (bad,) = [r for r in rows if r.record_type == "damaged"]
        assert (bad.record_id, bad.payload, bad.http_length) == (("urn:page:1", None, 3000) if passed is None else (None, None, passed)), name
        assert marked.filter("record_type = 'damaged'").collect() == [bad], name
        assert marked.filter("record_type = 'response'").count() == len(whole), name


def test_an_archive_of_blanks_and_one_cut_in_its_header(tmp_path):
    for data, marks in ((b"\r\n\r\n", 0), (b"WARC/1.1\r\nWARC-Type: resp", 1), (b"", 0), (b"\x1f\x8b\x08", 1)):
        (tmp_path / "x").write_bytes(data)
        with fs.LocalFileSystem().open_input_file(str(tmp_path / "x")) as file:
            assert [h["warc-type"] for h, _ in warc.Archive(file, mark=True).records(lambda h: True)] == ["damaged"] * marks
        with fs.LocalFileSystem().open_input_file(str(tmp_path / "x")) as file:
            if marks:
                with pytest.raises(warc.Damaged):
                    list(warc.Archive(file).records(lambda h: True))


# -- token files


@given(st.lists(st.lists(st.integers(0, 30) | st.integers(0, 2**32 - 1), max_size=200), max_size=12), st.integers(0, 5))
@settings(max_examples=60, deadline=None)
def test_coder_round_trip(blocks, extra):
    blocks = [np.array(b, np.uint32) for b in blocks] + [np.array([7, 8, 9] * (extra * 150), np.uint32)]
    coded = mixcoder.encode_blocks(blocks)
    assert all((a == b).all() for a, b in zip(blocks, mixcoder.decode_blocks(coded, [len(b) for b in blocks])))
    # blocks are independent: coded alone they give the same bytes
    assert all(mixcoder.encode_blocks([b])[0] == c for b, c in zip(blocks, coded))


def test_coder_learns():
    repeated = np.tile(np.random.default_rng(0).integers(0, 50_000, 64), 60).astype(np.uint32)
    assert len(mixcoder.encode_blocks([repeated])[0]) < len(repeated) * 4 / 12


def order0_bits(block, vocabulary):
    """Cost of a plain adaptive order-0 coder that starts anew: seen ids by their counts, new ones by an escape and then uniformly."""
    counts, bits = {}, 0.0
    for t, x in enumerate(block):
        if x in counts:
            bits -= math.log2((counts[x] - 0.5) / t)
        else:
            bits -= math.log2(max(0.5 * len(counts), 1) / max(t, 1)) - math.log2(vocabulary)
        counts[x] = counts.get(x, 0) + 1
    return bits


def test_coder_beats_plain_order_0():
    import pyarrow.parquet as pq
    import public_tokenizers

    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist()
    ids, _ = tokenfile.tokenizer(public_tokenizers.path(tokenfile.BYTE_BPE)).encode([t or "" for t in texts])
    zipf = np.random.default_rng(3).zipf(1.3, 20_000) % 50_000
    for ids in (ids, zipf):  # independent draws leave nothing to the higher orders
        blocks = [ids[k : k + mixcoder.BLOCK_IDS].astype(np.uint32) for k in range(0, len(ids), mixcoder.BLOCK_IDS)]
        coded = 8 * sum(map(len, mixcoder.encode_blocks(blocks)))
        assert coded < sum(order0_bits(b.tolist(), 50_000) for b in blocks)


def test_few_ids_cost_little_more_than_order_0():
    # with three ids, drawn independently, the higher orders have nothing to tell and the mix pays for learning that
    few = np.random.default_rng(4).choice([7, 40_000, 2**32 - 1], 4096, p=[0.9, 0.05, 0.05]).astype(np.uint32)
    assert 8 * len(mixcoder.encode_blocks([few])[0]) < 1.1 * order0_bits(few.tolist(), 2**32)


def test_token_files_equal_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(tokenfile.BYTE_BPE)
    library = Tokenizer.from_file(path)
    rng = random.Random(1)
    rows = odd_rows() + [(50, "a <|endoftext|> b\n\n  c\t'll  "), *((k, "".join(rng.choice("ab'sß \n\t中1².") for _ in range(rng.randint(0, 60)))) for k in range(60, 90))]
    folder = f"{shared_dir(spark)}/tokens"
    files = tokenfile.write_token_files(with_clashes(docs(spark, rows)), folder, path)
    got = sorted(tokenfile.read_token_files(files).collect(), key=lambda r: r.start)
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0]))
    start = 0
    for r, (doc, text) in zip(got, want, strict=True):
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        assert (r.doc_id, r.start, list(r.ids)) == (doc, start, ids)
        start += len(ids)
    none = tokenfile.write_token_files(docs(spark, rows).limit(0), folder, path)
    assert tokenfile.read_token_files(none).count() == 0


def test_order_0_is_not_summed_at_every_step(monkeypatch):
    """Repeats are added up at steps that grow apart, whatever the number of blocks and ids."""
    sums, add_up = [], mixcoder._Counts.add_up
    monkeypatch.setattr(mixcoder._Counts, "add_up", lambda self, t, numbers: (sums.append(t), add_up(self, t, numbers))[1])
    blocks = [np.random.default_rng(k).integers(0, 400, 4096 - 1000 * k).astype(np.uint32) for k in range(3)]
    coded = mixcoder.encode_blocks(blocks)
    steps, sums[:] = list(sums), []
    assert all((a == b).all() for a, b in zip(blocks, mixcoder.decode_blocks(coded, [len(b) for b in blocks])))
    assert sums == steps and len(steps) < 60
    with pytest.raises(ValueError, match="at most"):
        mixcoder.encode_blocks([np.zeros(mixcoder.MOST_IDS + 1, np.uint32)])


def test_words_are_remembered_between_blanks(monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(tokenfile.BYTE_BPE)
    library, fast = Tokenizer.from_file(path), tokenfile.PieceTokenizer(path)
    asked, ask = [], fast._library
    monkeypatch.setattr(fast, "_library", lambda piece: (asked.append(piece), ask(piece))[1])
    monkeypatch.setattr(tokenfile, "MOST_KNOWN", 60)
    rng = random.Random(7)
    some = ["a", "B", "'s", "'ll", " ", "  ", "\n", "\t", "é", "中", "1", ".", "!?", "<|endoftext|>", "\xa0", "\x1c", "\u2028", "ß", "x" * 70, "\r\n", "😀"]
    for _ in range(60):
        texts = ["".join(rng.choice(some) if rng.random() < 0.7 else " " for _ in range(rng.randint(0, 30))) for _ in range(12)]
        ids, offsets = fast.encode(texts)
        for k, text in enumerate(texts):
            assert ids[offsets[k] : offsets[k + 1]].tolist() == library.encode(text, add_special_tokens=False).ids
        assert len(fast.known) < 2000  # rare words are forgotten
    texts = ["one, two\nthree, four one, two\nthree"] * 3
    fast.encode(texts)
    asked.clear()
    monkeypatch.setattr(fast, "_plain", lambda text: 1 / 0)  # nothing is cut again
    ids, offsets = fast.encode(texts)
    assert not asked and ids[: offsets[1]].tolist() == library.encode(texts[0], add_special_tokens=False).ids


def test_damaged_blocks_are_noticed(tmp_path):
    with fs.LocalFileSystem().open_output_stream(str(tmp_path / "x")) as out:
        writer = tokenfile.TokenFileWriter(out)
        writer.add([1, None], np.arange(9000, dtype=np.uint32), np.array([0, 5000, 9000]))
        writer.close()
    data = bytearray((tmp_path / "x").read_bytes())
    (docs_, lists) = next(tokenfile.read_token_file(pa.BufferReader(bytes(data))))
    assert docs_ == [1, None] and lists[0].tolist() == list(range(5000))
    data[40] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        list(tokenfile.read_token_file(pa.BufferReader(bytes(data))))


def test_bytes_without_intervals_equal_plain_cuts():
    rng = random.Random(17)
    texts = [None, "", "é" * 20, *("".join(rng.choice("abé中") for _ in range(rng.randint(0, 60))) for _ in range(30))]
    found = []
    for t in texts:
        size = len((t or "").encode())
        cuts = [sorted((rng.randint(0, size), rng.randint(0, size))) for _ in range(rng.randint(0, 5))]
        found.append([{"start": a, "stop": b} for a, b in cuts if a < b] or rng.choice([None, []]))
    found[2] = [{"start": 30, "stop": 40}, {"start": 0, "stop": 3}, {"start": 3, "stop": 5}]
    for first in (0, 2):  # a slice too
        batch = pa.RecordBatch.from_arrays(
            [pa.array(range(len(texts))), pa.array(texts, pa.string()), pa.array(found, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))],
            names=["doc_id", "text", "found"],
        ).slice(first)
        for r, t, cuts in zip(suffixdedup.without(batch).to_pylist(), texts[first:], found[first:]):
            data = (t or "").encode()
            gone = {k for c in cuts or () for k in range(c["start"], c["stop"])}
            starts = sorted(k for k in gone if k - 1 not in gone)
            assert r["kept"] == bytes(x for k, x in enumerate(data) if k not in gone) and r["n_bytes"] == len(data)
            assert r["n_removed"] == len(gone) and r["n_spans"] == len(starts) and [s["start"] for s in r["spans"]] == starts
