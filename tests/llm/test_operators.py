"""Operators on a small fixture against brute force: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest

from weftline.llm import byte_bpe, hamming_index, html_text, near_dup, packing, pii, quality, scratch, sharding, suffix_dedup, token_store
from weftline.llm.words import library_tokenizer

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BASE = "The quick brown fox jumps over the lazy dog while seven wise owls watch from the old oak tree near the river bank at dusk and nobody says a word about it until the morning comes again"
SCHEMA = "doc_id long, text string, lang string, rid long, size long, shard int, _c0 string, rest double, row string, _row string, no_text boolean, spans int, head binary, `a.b` string"
MORE = ("r", "same", True, 1, b"h", "d")


def fixture_rows():
    texts = [BASE, BASE, BASE.replace("owls", "cats"), BASE.upper(), None, "", " \n\t ", "one", "two words", "x" * 30_000, "Mail a.b@c.example.com or +1 (212) 555-1234, 10.0.0.1, 4111 1111 1111 1111.", "same line\nsame line\nsame line", "Prefix é " + BASE + " suffix", "a b c d e f g h i j a b c d e", "### *** $$$ " * 12]
    rows = [(i, t, "en", -i, 7, 3, "c", 0.5, *MORE) for i, t in enumerate(texts)]
    return rows + [(None, BASE, *[None] * 12), (2, texts[2], "en", 1, 1, 1, "c", 1.0, *MORE)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(fixture_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def ids_of(name, text):
    return [*library_tokenizer(P.path(name)).encode(text or "", add_special_tokens=False).ids, 2]


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def test_token_store(spark, docs, none):
    for df, rows in ((docs, fixture_rows()), (none, [])):
        path = scratch.scratch_path(spark, "store")
        token_store.write_token_store(df, path, P.path("byte_bpe_50k.json"), segment_tokens=50)
        got = [tuple(r) for r in token_store.ids_crc32(token_store.read_token_store(spark, path)).collect()]
        at, want = 0, []
        for key, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
            ids = ids_of("byte_bpe_50k.json", text)
            want.append((key, at, len(ids), crc(ids)))
            at += len(ids)
        assert sorted(got, key=repr) == sorted(want, key=repr)


def test_packing(docs, none):
    got = packing.digest(packing.packed(docs, P.path("word_bpe_49k.json"), window=64)).collect()
    want = Counter((k, tuple(ids_of("word_bpe_49k.json", t))) for k, t, *_ in fixture_rows())
    by_key = {}
    for (k, ids), n in want.items():
        by_key.setdefault(k, []).extend([ids] * n)
    assert sum(r.length for r in got) == sum(len(i) for v in by_key.values() for i in v)
    for r in got:
        assert any(len(ids) == r.doc_tokens and crc(ids[r.start : r.start + r.length]) == r.ids_crc32 for ids in by_key[r.doc_id])
    full = 0
    for s in {r.sequence_id for r in got}:
        at = 0
        for r in sorted((r for r in got if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64
        full += at == 64
    assert full >= len({r.sequence_id for r in got}) - 1
    assert packing.packed(none, P.path("word_bpe_49k.json")).count() == 0


def test_sharding(docs, none):
    got = sharding.sharded(docs, shards=4).collect()
    assert len(got) == len(fixture_rows()) and {r.law for r in got} == {"bytes"}
    assert sorted((r.doc_id or -1, r["size"], r.text_crc32) for r in got) == sorted((k or -1, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for k, t, *_ in fixture_rows())
    for s in {r.shard for r in got}:
        mine = sorted(r.slot for r in got if r.shard == s)
        assert mine == list(range(len(mine))) and 0 <= s < 4
    assert sharding.sharded(none).count() == 0


def test_byte_bpe(docs, none):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    got = byte_bpe.round_trip(docs, path, P.PATTERN).collect()
    assert sorted(r.decoded_sha256 for r in got) == sorted(hashlib.sha256((t or "").encode()).hexdigest() for _, t, *_ in fixture_rows())
    ids = byte_bpe.encoded(docs, path, P.PATTERN)
    assert sorted(r.text for r in byte_bpe.decoded(ids, path, P.PATTERN).collect()) == sorted(t or "" for _, t, *_ in fixture_rows())
    assert byte_bpe.round_trip(none, path, P.PATTERN).count() == 0


def brute_quality(text):
    text = text or ""
    w = WORD.findall(text)
    c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    repeated = {j for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(x in quality.SYMBOLS for x in "".join(w)), len(lines) - len(set(lines)), len(repeated)


def test_quality(docs, none):
    got = quality.judged(docs).collect()
    key = lambda r: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
    assert sorted(map(key, got)) == sorted(brute_quality(t) for _, t, *_ in fixture_rows())
    assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.base_failed and r.kept) for r in got)
    assert all(r.kept for r in got if r.doc_id in (0, 1, 2))
    kept = quality.kept_documents(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got)
    assert {tuple(r)[8:] for r in kept.filter("doc_id is not null").collect()} == {MORE}
    assert quality.judged(none).count() == 0


def brute_components(rows, k, p):
    low = {c: c + 32 for c in range(65, 91)}
    sets = []
    for _, t, *_ in rows:
        w = WORD.findall((t or "").translate(low))
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= p * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [b if r == a else r for r in root]
    return sets, root


def test_near_duplicates(docs, none):
    rows = fixture_rows()
    sets, root = brute_components(rows, 3, 80)
    want = []
    for i, (k, *_) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root[j] == root[i] and rows[j][0] is not None]
        c = (min(ids) if ids else None) if sets[i] else k
        want.append((k, len(sets[i]), c, k == c))
    got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(docs, k=3, p=80, block_bytes=256).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    kept = near_dup.kept_documents(docs, k=3, p=80)
    assert {tuple(r)[8:] for r in kept.filter("doc_id is not null").collect()} == {MORE}
    assert kept.columns == docs.columns and kept.count() == len({(r if sets[i] else ("alone", i)) for i, r in enumerate(root)})
    assert near_dup.near_duplicates(none).count() == 0


def spark_of(df):
    return df.sparkSession


def brute_repeats(rows):
    seen, out = set(), []
    for k, t, *_ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            w = b[p : p + 100]
            if w in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((k, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


def test_repeats(docs, none):
    got = [tuple(r) for r in suffix_dedup.repeats_removed(docs).drop("rid").collect()]
    assert sorted(got, key=repr) == sorted(brute_repeats(fixture_rows()), key=repr)
    got = [tuple(r) for r in suffix_dedup.repeats_removed(docs, crowd=1).drop("rid").collect()]
    assert sorted(got, key=repr) == sorted(brute_repeats(fixture_rows()), key=repr)
    assert not [t for t in spark_of(docs).catalog.listTables() if t.name.startswith("weftline")]
    cleaned = suffix_dedup.cleaned_documents(docs)
    others = lambda df: sorted((tuple(r) for r in df.drop("text").collect()), key=repr)
    assert others(cleaned) == others(docs)
    assert cleaned.columns == docs.columns and cleaned.count() == docs.count()
    assert cleaned.filter("text is null").count() == 1
    assert suffix_dedup.repeats_removed(none).count() == 0


def test_personal_data(docs, none):
    got = {r.doc_id: r for r in pii.detected(docs).select("doc_id", pii.listed(pii.KINDS).alias("s")).collect()}
    text = fixture_rows()[10][1]
    spans = [x.split(":") for x in got[10].s.split(",")]
    assert [(k, text[int(a) : int(b)]) for k, a, b in spans] == [("email", "a.b@c.example.com"), ("ip", "10.0.0.1"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (212) 555-1234")]
    assert all(not r.s for k, r in got.items() if k != 10)
    out = {r.doc_id: r.text for r in pii.redacted(docs).collect()}
    assert out[10] == "Mail [EMAIL] or [PHONE], [IP], [CARD]." and out[0] == BASE and out[4] is None
    assert pii.detected(none).count() == 0
    others = lambda df: sorted((tuple(r) for r in df.drop("text").collect()), key=repr)
    assert others(pii.redacted(docs)) == others(docs)


def test_contexts_find_more(spark):
    rows = [(i, f"word{'abcdefgh'[i % 8]} card {n} and badge {n} end") for i, n in enumerate(["4111111111111111", "5500005555555559", "4012888888881881", "5105105105105100", "4222222222222220"] * 3)]
    rows += [(100 + i, "my card 1234567812345678 and badge 1234567812345678 end") for i in range(2)] + [(200, "year 1234567812345678999999 was long")]
    got = {r.doc_id: r.context for r in pii.detected(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got[100]) == 2 and not got[200] and not got[0]


def test_base_spans_equal_brute_force(spark):
    """The contract's patterns by Python's re on made-up texts."""
    import random

    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m, d: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m, d: all(int(x) <= 255 for x in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m, d: 13 <= len(d) <= 19 and luhn(d)),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m, d: 9 <= len(d) <= 15),
    }
    rnd = random.Random(6)
    bits = ["a.b@c.de", "x@y", "@", ".", "10.0.0.1", "300.1.1.1", "4111 1111 1111 1111", "4111111111111111", "+1 (212) 555-1234", "+", "7", " ", " ", "-", "é", "世", "\n", "word", "1.2.3.4.5"]
    rows = [(i, "".join(rnd.choice(bits) for _ in range(rnd.randrange(14)))) for i in range(400)]
    want = {}
    for i, t in rows:
        want[i] = ",".join(f"{k}:{m.start()}:{m.end()}" for k, (p, ok) in kinds.items() for m in re.finditer(p, t) if ok(m[0], re.sub("[^0-9]", "", m[0])))
    got = {r.doc_id: r.s for r in pii.detected(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", pii.listed(pii.KINDS[:4]).alias("s")).collect()}
    assert got == want


def test_assigned_literals_are_seeds(spark):
    rows = [(i, f'some words here token = "{i:04}beef{i * 7919:032x}" and more of them') for i in range(6)]
    rows += [(10, 'set key: \'Zx81-AbCd+efGh/0123456789\' now'), (11, 'title = "a plain long quoted title"'), (12, 'version = "10203040506070809010203"'), (13, "deadbeef" * 5)]
    got = {r.doc_id: r.context for r in pii.detected(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    text = dict(rows)
    assert all([text[i][s.start : s.end] for s in got[i]] == [text[i].split('"')[1]] for i in range(6))
    assert len(got[10]) == 1 and not got[11] and not got[13]


def test_contexts_find_what_occurs_once(spark):
    cards = ["4111111111111111", "5500005555555559", "4012888888881881", "5105105105105100", "4222222222222220"]
    rows = [(i, f"word{i} card {n} and phone +1 (743) 555-382{i} end of {n} text") for i, n in enumerate(cards)]
    # the second round knows `badge` only by what `card` and `phone` admitted in the first
    rows += [(100, "a card 1234567812345678 was lost"), (101, "my phone (743) 555-9999, at home"), (102, "phone 743 555 1111")]
    rows += [(110 + i, f"card AB-55555{i} or badge AB-55555{i}") for i in range(4)]
    rows += [(120, "see badge 99887766"), (121, "made of 1234567890123 pieces")]
    rows += [(300 + i, "a lot of plain words made of nothing " * 100) for i in range(3)] + [(310 + i, f"mail of a{i}@b.example.com") for i in range(6)]
    # enough seeds that a few unknown instances leave the cues confident
    rows += [(400 + i, f"card 10.0.0.{i} then phone +1 (743) 556-00{i:02}") for i in range(40)]
    got = {r.doc_id: r.context for r in pii.detected(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    text = dict(rows)
    found = {k: [text[k][s.start : s.end] for s in v] for k, v in got.items() if v}
    assert found == {100: ["1234567812345678"], 101: ["(743) 555-9999"], 102: ["743 555 1111"], **{110 + i: [f"AB-55555{i}"] * 2 for i in range(4)}, 120: ["99887766"]}


def test_nearest(spark):
    rnd = np.random.default_rng(3)
    x = rnd.normal(size=(400, 16))
    x[7] = x[8]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, []), (None, [1.0] * 16), (904, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("vec_id", "embedding", "1 as rank", "2 as score")
    got = hamming_index.nearest(df, df.filter("vec_id % 8 = 0"), k=5).collect()
    hit = 0
    for q in range(0, 400, 8):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        want = [i for i in np.lexsort((np.arange(400), d)) if i != q][:5]
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        hit += len({r.vec_id for r in mine} & set(want))
        assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5] and all(r.score == d[r.vec_id] for r in mine)
    assert hit >= 0.9 * 250 and not {r.query_id for r in got} & {900, 901, 902, 903, 904}
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert hamming_index.nearest(none, none).count() == 0
    one = df.filter("vec_id = 3")
    assert hamming_index.nearest(one, one).count() == 0
    two = df.filter("vec_id < 2")
    assert hamming_index.nearest(two, two).count() == 2


def test_repeated_neighbours_are_rows(spark):
    rows = [(i, [float(i), 1.0, 2.0, 3.0]) for i in range(4)]
    df = spark.createDataFrame(rows + [rows[1], rows[0]], "vec_id long, embedding array<double>")
    got = hamming_index.nearest(df, df.filter("vec_id = 0"), k=3).collect()
    assert sorted((r["rank"], r.vec_id, r.score) for r in got) == [(1, 1, 1.0), (2, 1, 1.0), (3, 2, 2.0)]
    many = spark.createDataFrame([(i, [float(i), 1.0, 2.0, 3.0]) for i in range(40)] + [rows[1]] * 30, "vec_id long, embedding array<double>")
    got = hamming_index.nearest(many, many.filter("vec_id = 0"), k=33, part_rows=8).collect()
    assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"])] == [1] * 31 + [2, 3]


def test_pages(spark):
    rows = [(1, "u", "<article><p>Hello &amp; welcome to the page of text.</p></article>", "x"), (None, None, None, "x"), (2, "v", "", "x"), (2, "v", "", "x")]
    got = html_text.extracted(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in got) == [(0, "", 0), (1, "Hello & welcome to the page of text.", 36), (2, "", 0), (2, "", 0)]


def test_pipeline(spark):
    import corpus_pipeline

    rows = [r for r in fixture_rows() if r[0] is not None]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t, *_ in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = scratch.stored(stage(spark, docs, ""), "stage")
        if i < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if i == 1:
            ids = sorted(r.doc_id for r in docs.collect())
            assert 0 in ids and not {1, 4, 5, 6, 7, 8} & set(ids)
    assert {r.doc_id for r in docs.collect()} == set(ids)
