"""Language ID, decontamination, secrets, word BPE: brute force, round trips, edge rows."""

from __future__ import annotations

import base64
import bz2
import gzip
import lzma
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from helpers import LONG, PLAIN, docs, odd_rows, with_clashes
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from chartloom.llm import decontam, langid, secrets, wordbpe
from chartloom.llm.common import Words, word_class

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path(wordbpe.WORD_BPE)


# -- words


@given(st.lists(st.one_of(st.none(), st.text(alphabet=" \taBZé-9中", max_size=30)), min_size=1, max_size=6))
@settings(max_examples=60, deadline=None)
def test_words_and_shingles_equal_brute_force(texts):
    words = Words(pa.array(texts, pa.string()), ~word_class((9, 13), (32, 32)))
    lower = lambda b: bytes(c + 32 if 65 <= c <= 90 else c for c in b)
    lists = [[lower(w) for w in re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())] for t in texts]
    assert [[words.text(k) for k in range(a, b)] for a, b in zip(words.first, words.first[1:])] == lists
    h, row, _ = words.shingles(3, short=True)
    brute = [(d, tuple(w[k : k + 3])) for d, w in enumerate(lists) if w for k in range(max(1, len(w) - 2))]
    assert sorted(row.tolist()) == sorted(d for d, _ in brute)
    assert len(set(zip(row.tolist(), h.tolist()))) == len(set(brute))


# -- language ID


def test_matrix_of_weights_equals_the_kernel_machine():
    texts = [t for t in (PLAIN, "der alte Mann und das Meer", "le vieil homme et la mer", "ein kleines blaues Buch", "un petit livre bleu") for _ in (0, 1)]
    langs = ["en", "en", "de", "de", "fr", "fr", "de", "de", "fr", "fr"]
    x = langid.presence(texts)
    model = langid.fit(x, langs, landmarks=6)
    # the same by way of kernel values
    names = sorted(set(langs))
    by = {n: [k for k, v in enumerate(langs) if v == n] for n in names}
    marks = x[[by[n][k] for k in range(4) for n in names if k < len(by[n])][:6]]
    values, vectors = np.linalg.eigh(langid.kernel(marks, marks))
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    z = langid.kernel(x, marks) @ root
    target = np.array([[1.0 if v == n else -1.0 for n in names] for v in langs])
    share = np.array([1 / len(by[v]) for v in langs])[:, None] * len(langs) / len(names)
    w = np.linalg.solve(z.T @ (z * share) + langid.RIDGE * np.eye(z.shape[1]), z.T @ (target * share))
    test = langid.presence(["a small blue book", "das kleine Meer", "la mer bleue"])
    direct = langid.kernel(test, marks) @ root @ w
    f = (test.astype(np.float32) @ model.weights) / np.sqrt(test.sum(axis=1, dtype=np.int64))[:, None]
    assert np.allclose(direct, f, atol=1e-4)


def test_presence_equals_sets_of_grams():
    text = "Abc, abd!"
    letters = " abc abd "
    grams = {letters[k : k + n] for n in (1, 2, 3) for k in range(len(letters) - n + 1)}
    assert langid.presence([text])[0].sum() == len(grams)  # no two of these share a slot
    assert not langid.presence(["12 %%", None, ""]).any()


def test_held_out_accuracy(spark):
    from chartloom.llm.common import table

    got = langid.op3_language_id(spark, "/root/testdata/sf0.01").join(table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.97


def test_language_edges(spark):
    rows = [*odd_rows(), (9, "der alte Mann", "de"), (10, "der Mann am Meer", "de"), (11, "kein Label", None)]
    frame = with_clashes(docs(spark, rows))
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(frame, langid.train(frame)).collect()}
    assert got[2] == got[3] == got[7] == ("und", 0.0) and got[1][0] == "en"
    empty = frame.limit(0)
    assert langid.identify(empty, langid.train(empty)).count() == 0
    none = langid.train(frame.filter("lang IS NULL"))
    assert {r.lang_pred for r in langid.identify(frame, none).collect()} == {"und"}


def test_training_ignores_held_out_rows(spark):
    kept = [k for k in range(200) if zlib.crc32(str(k).encode()) % 5]
    held = [k for k in range(200) if not zlib.crc32(str(k).encode()) % 5]
    rows = [(k, f"der Mann {k}", "de") for k in kept] + [(k, f"le homme {k}", "fr") for k in held]
    assert langid.train(docs(spark, rows), max_rows=50).languages == ["de"]


# -- decontamination


def brute_items(texts, items, percent=80):
    def shingles(t):
        w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}

    out = set()
    for d, t in texts:
        own = shingles(t)
        for i, x in items:
            want = shingles(x)
            if want and 100 * len(want & own) >= percent * len(want):
                out.add((d, i, len(want), len(want & own)))
    return out


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(5)
    vocabulary = ["sea", "boat", "wall", "lamp", "été", "Book", "7"]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, say(rng.randint(3, 40))) for k in range(40)] + [(40, None), (41, ""), (42, "one two three four"), (43, PLAIN), (44, PLAIN)]
    texts = [(k, say(rng.randint(0, 300))) for k in range(40)]
    for k in range(40, 80):
        words = items[k - 40][1].split()
        if words and k % 2:
            words[rng.randrange(len(words))] = "changed"
        texts.append((k, say(50) + ", " + " ".join(words) + ". " + say(50)))
    texts += [(80, None), (81, ""), (82, PLAIN.upper()), (83, LONG + PLAIN)]
    frame = with_clashes(docs(spark, texts))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (1 << 20, 500):  # one block, then several
        got = {tuple(r)[:4] for r in decontam.contained_items(frame, bench, block_bytes=block).collect()}
        assert got == brute_items(texts, items)
    left = {r.doc_id for r in decontam.decontaminate(frame, bench).select("doc_id").collect()}
    assert left == {d for d, _ in texts} - {d for d, *_ in got}
    assert decontam.contained_items(frame, bench.limit(0)).count() == 0 == decontam.contained_items(frame.limit(0), bench).count()


# -- secrets

KINDS = [
    ("assign", re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")),
    ("access", re.compile("AKIA[A-Z0-9]+")),
    ("hex", re.compile("[0-9a-f]+")),
]


def brute_spans(text):
    out = []
    for number, (kind, pattern) in enumerate(KINDS):
        for m in pattern.finditer(text):
            if (len(m[2]) >= 8) if kind == "assign" else len(m[0]) >= (16 if kind == "access" else 32):
                out.append((m.start(), number, m.end()))
    return sorted(out)


@given(st.lists(st.sampled_from(["token", "SECRET", "api_key", "apiKey", "passwd", "=", ":", " ", '"', "abc", "12345678", "AKIA", "ABCDEF123456", "deadbeef", "é", "ſecret", "K", "x" * 9]), max_size=14))
@settings(max_examples=300, deadline=None)
def test_base_spans_equal_plain_patterns(parts):
    text = "".join(parts)
    assert secrets.base_spans(text) == brute_spans(text)
    base, spans, _, _ = secrets.all_spans(text)
    assert set(base) <= set(spans)


SECRET = "api_key = abcdEFGH1234"
WRAPS = {
    "url": lambda s: "".join(f"%{b:02X}" for b in s.encode()),
    "unicode": lambda s: "".join(f"\\u{ord(c):04x}" for c in s),
    "base64": lambda s: base64.b64encode(s.encode()).decode(),
    "gzip": lambda s: base64.b64encode(gzip.compress(s.encode())).decode(),
    "zlib": lambda s: base64.b64encode(zlib.compress(s.encode())).decode(),
}


@pytest.mark.parametrize("outer", WRAPS)
@pytest.mark.parametrize("inner", WRAPS)
def test_nested_layers_map_back(outer, inner):
    wrapped = WRAPS[outer](WRAPS[inner](SECRET))
    text = f"é {wrapped} end"
    _, spans, layers, _ = secrets.all_spans(text)
    assert layers >= 3
    hit = [(s, e) for s, kind, e in spans if kind == 0]
    # padding signs of base64 are not part of a decoded layer's characters
    assert any(s == 2 and e >= 2 + len(wrapped.rstrip("=")) - 16 and e <= 2 + len(wrapped) for s, e in hit)


def test_cycles_and_bombs_end():
    assert secrets.all_spans("%25" * 50)[2] < 60
    bomb = WRAPS["gzip"]("a" * 100_000)
    assert secrets.all_spans(bomb, most=1000)[3] == 1
    assert secrets.all_spans(WRAPS["gzip"]("x" * 5000 + " " + SECRET))[1]


def spans_of(text, **limits):
    return [(s, kind, e) for s, kind, e in secrets.all_spans(text, **limits)[1]]


def b64(data):
    return base64.b64encode(data).decode()


@pytest.mark.parametrize("pack", [gzip.compress, zlib.compress, bz2.compress, lzma.compress])
@pytest.mark.parametrize("inner", [gzip.compress, zlib.compress, bz2.compress, lzma.compress])
def test_streams_inside_streams_and_later_members(pack, inner):
    run = b64(pack(inner(SECRET.encode())))
    assert (3, 0, 3 + len(run)) in spans_of("é: " + run + " end")
    if pack is not zlib.compress:
        run = b64(pack(b"nothing here at all") + pack(b"still nothing ...") + pack(SECRET.encode()))
        assert (0, 0, len(run)) in spans_of(run)  # xz may store short texts plainly, which shows a second, narrower span


@pytest.mark.parametrize("prefix", ["/", "_", "-", "a/", "ab/", "abc/", "https://example.com/v1/", "key-", "x_y_"])
@pytest.mark.parametrize("wrap", ["base64", "gzip"])
def test_base64_behind_characters_of_its_own_alphabet(prefix, wrap):
    run = WRAPS[wrap](SECRET)
    hits = [(s, e) for s, kind, e in spans_of("see " + prefix + run) if kind == 0]
    start = 4 + len(prefix)
    # bytes straddle characters: a stream's first byte may begin in the character before
    assert any(start - 1 <= s <= start and start + len(run.rstrip("=")) <= e + 1 for s, e in hits)


def test_one_undecodable_unit_does_not_hide_its_run():
    plain = SECRET.encode()
    cases = {
        "%00": "%00" + WRAPS["url"](SECRET) + "%ff",
        "%ff%41%ff": "%ff%41%ff" + WRAPS["url"](SECRET),
        "surrogate": "\\ud800" + WRAPS["unicode"](SECRET) + "\\udc00",
        "control": b64(b"\x00\x01" + plain + b"\x00 and more\xff"),
        "binary": b64(bytes(range(128, 256)) + plain + bytes(range(128, 256))),
        "inflated": b64(gzip.compress(b"\x00\xff" * 50 + plain + b"\x00")),
    }
    for name, text in cases.items():
        assert any(kind == 0 for _, kind, _ in spans_of(text)), name
    (start, _, end), = spans_of(cases["%00"])
    assert (start, end) == (3, 3 + 3 * len(plain))
    (start, _, end), = spans_of(cases["surrogate"])
    assert (start, end) == (6, 6 + 6 * len(plain))


@pytest.mark.parametrize("width", [16, 64, 76])
@pytest.mark.parametrize("line_end", ["\n", "\r\n", "\n   "])
@pytest.mark.parametrize("packed", [False, True])
def test_wrapped_base64_is_one_run(width, line_end, packed):
    noise = bytes(random.Random(5).randrange(256) for _ in range(150))
    data = noise + SECRET.encode()
    run = b64(gzip.compress(data) if packed else b"n" * 30 + b" " + SECRET.encode())
    text = line_end.join(run[k : k + width] for k in range(0, len(run), width))
    hits = [(s, e) for s, kind, e in spans_of("key file:\n" + text + "\nend of it") if kind == 0]
    assert any(s >= 10 and e >= 10 + len(text.rstrip("=")) - 4 for s, e in hits)


def test_long_streams_are_read_in_windows():
    """A secret at any place of a stream of many windows is found, at a border too, in streams inside streams too."""
    for at in (0, 4095, 4090, 8192, 50_000):
        data = b"." * at + b" " + SECRET.encode() + b" " + b"." * (60_000 - at)
        for run in (b64(gzip.compress(data)), b64(bz2.compress(gzip.compress(data, 0)))):
            assert (0, 0, len(run)) in spans_of(run, window=4096, overlap=256)
    bomb = b64(gzip.compress(b"." * 5_000_000))
    _, spans, _, unread = secrets.all_spans(SECRET + " " + bomb, most=2_000_000)
    assert spans == [(0, 0, len(SECRET))] and unread == 1 and secrets.all_spans(bomb)[3] == 0


def test_unread_streams_leave_the_text(spark):
    bomb = b64(gzip.compress(b"." * 5_000_000 + SECRET.encode()))
    frame = docs(spark, [(1, "before " + bomb + " after"), (2, PLAIN)])
    assert [r.n_oversized for r in secrets.scan_secrets(frame, 1_000_000).orderBy("doc_id").collect()] == [1, 0]
    red = {r.doc_id: r.text for r in secrets.redact_secrets(frame, 1_000_000).collect()}
    assert red == {1: "before [unread] after", 2: PLAIN}
    assert {r.doc_id: r.text for r in secrets.redact_secrets(frame).collect()}[1] == "before [assign] after"


@given(st.binary(max_size=200))
@settings(max_examples=200, deadline=None)
def test_any_bytes_are_scanned_without_error(data):
    for text in (b64(data), "/" + b64(data), "".join(f"%{b:02x}" for b in data), "".join(f"\\x{b:02x}" for b in data), b64(gzip.compress(data)[:-3])):
        base, spans, _, _ = secrets.all_spans(text)
        assert set(base) <= set(spans) and all(0 <= s < e <= len(text) for s, _, e in spans)


def test_secret_edges(spark):
    rows = [*odd_rows(), (20, LONG + SECRET), (21, SECRET + " and token=12345678")]
    frame = with_clashes(docs(spark, rows))
    got = secrets.scan_secrets(frame).collect()
    assert len(got) == len(rows) and all(r.spans == "" for r in got if r.doc_id in (1, 2, 3, 4, None))
    assert [r.spans for r in got if r.doc_id == 21] == ["assign:0:22,assign:27:41"]
    red = {r.doc_id: r.text for r in secrets.redact_secrets(frame).collect()}
    assert red[21] == "[assign] and [assign]" and red[2] is None and red[3] == "" and red[1] == PLAIN
    assert secrets.redact_secrets(frame).columns == frame.columns and secrets.scan_secrets(frame.limit(0)).count() == 0


# -- word BPE


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    return tokenizer


POOL = "aAbeEiIİßẞΣσςéÅñœŒſK中あ字한😀👍🏽‍́\xa0 \x85\x1c\t\n'\"’_-.,!%$0189²½Ⅷ٣﻿किǅ<|>"


@given(st.lists(st.text(alphabet=POOL, max_size=25), min_size=1, max_size=8))
@settings(max_examples=150, deadline=None)
def test_bpe_equals_the_library(library, texts):
    texts = [*texts, "I'm <|endoftext|>we'll <|ENDOFTEXT|>", "antidisestablishmentarianism" * 3]
    own = wordbpe.tokenizer(PATH)
    ids, at = own.encode(texts)
    lists = [ids[a:b].tolist() for a, b in zip(at, at[1:])]
    assert lists == [library.encode(t, add_special_tokens=False).ids for t in texts]
    array = pa.array(lists, pa.list_(pa.int32()))
    assert own.decode(array).to_pylist() == [library.decode(x, skip_special_tokens=False) for x in lists]


def test_stable_neighbours_decide_and_the_rest_is_merged():
    own = wordbpe.WordBpe(PATH)
    rng = random.Random(3)
    words = {"".join(rng.choice("etaoinshr") for _ in range(rng.randint(1, 14))) for _ in range(2000)}
    own.learn(words)
    assert 0 < own.fallbacks < len(words)
    exact, sizes = own.merge(*own._spelled(sorted(words)))
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    for k, w in enumerate(sorted(words)):
        at = own.known[w]
        assert own.flat[own.starts[at] : own.starts[at + 1]].tolist() == exact[cuts[k] : cuts[k + 1]].tolist()


def test_bpe_edges(spark, library):
    rows = odd_rows()
    frame = with_clashes(docs(spark, rows))
    got = wordbpe.with_ids_digest(wordbpe.decode(wordbpe.encode(frame, PATH), PATH)).collect()
    assert len(got) == len(rows)
    for r, (_, text) in zip(sorted(got, key=lambda r: (r.doc_id is None, r.doc_id)), sorted(rows, key=lambda r: (r[0] is None, r[0]))):
        assert list(r.ids) == library.encode(text or "", add_special_tokens=False).ids and r.n_tokens == len(r.ids)
    assert wordbpe.encode(frame.limit(0), PATH).count() == 0


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(wordbpe, "MOST_KNOWN", 5)
    own, other = wordbpe.WordBpe(PATH), wordbpe.tokenizer(PATH)
    for text in (PLAIN, "quite other words", PLAIN):
        assert own.encode([text])[0].tolist() == other.encode([text])[0].tolist()
