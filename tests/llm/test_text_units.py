"""Parts without Spark: coding, packing plans, tries, anchors, cuts, indexes, near-duplicate groups."""

import itertools
import random

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.llm import hamming_index, html_text, near_dup, packing, suffix_dedup
from weftline.llm.blind_trie import deep_shallow
from weftline.llm.byte_bpe import ByteBPE, read_ranks
from weftline.llm.elias_fano import EliasFano
from weftline.llm.token_store import Segment, pack_segment
from weftline.llm.words import library_encoder, library_tokenizer

TEXT = st.text(st.sampled_from([*"abé ñ世😀\n\t.,'!1", "\xa0", "\x1c", "́"]) | st.sampled_from("THE the of"), max_size=60)


@given(st.lists(st.integers(0, 5000), max_size=200))
@settings(max_examples=60, deadline=None)
def test_elias_fano(values):
    values = sorted(values)
    e, n = EliasFano.from_bytes(EliasFano.encode(values).to_bytes())
    assert e.values().tolist() == values == [e.select(i) for i in range(len(values))]


def test_segment():
    pieces = [b"\1\0\2\0", b"", b"\3\0"]
    s = Segment(pack_segment([None, 5, 5], pieces, 2))
    assert s.doc_ids() == [None, 5, 5] and [s.ids(i).tolist() for i in range(3)] == [[1, 2], [], [3]]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@given(TEXT)
@settings(max_examples=150, deadline=None)
def test_chunks_equal_whole_texts(name, text):
    e, t = library_encoder(P.path(name)), library_tokenizer(P.path(name))
    assert np.frombuffer(e(text), e.dtype).tolist() == t.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_letters_that_come_apart(name):
    """The tokenizer's ids where normalisation breaks letters up; a plain tokenizer differs in the strings of special tokens alone, which are text here."""
    from tokenizers import Tokenizer

    e, plain = library_encoder(P.path(name)), Tokenizer.from_file(P.path(name))
    texts = [f"ab d{chr(c)}. f{chr(c)} {chr(c)}, x{chr(c)}%%% \n{chr(c)}b." for c in (*range(0x80, 0x3000), 0xFB2A, 0xFB4E, 0x1E9E)]
    texts += ["", "a\nÉb.", "aª b.º cµ, ª", "a`b c` d~ e^", "a\n.b", "a\n'b'", "end.'s"]
    got = e.batch(texts, stretch=20_000)
    want = [np.asarray(plain.encode(t, add_special_tokens=False).ids, e.dtype).tobytes() for t in texts]
    assert got.to_pylist() == want
    special = "a <|endoftext|> b"
    assert np.frombuffer(e(special), e.dtype).tolist() == library_tokenizer(P.path(name)).encode(special, add_special_tokens=False).ids != plain.encode(special, add_special_tokens=False).ids


def test_byte_bpe_equals_tiktoken():
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    own, theirs = ByteBPE(path, P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(path), special_tokens={})
    rnd = random.Random(5)
    bits = ["a", "the ", "ing", " ", "  ", "\n", "\t", "é", "世", "😀", "1", "!", "abab", "'s", "\xa0", "\x85", "<|endoftext|>"]
    for _ in range(500):
        text = "".join(rnd.choice(bits) for _ in range(rnd.randrange(40)))
        ids = own.encode(text)
        assert ids == theirs.encode_ordinary(text) and own.decode_text(ids) == text == "".join(own.decode_stream(ids))
        spans = own.offsets(text)
        assert all(text[a:b].encode().find(own.bytes_of[i]) >= 0 for i, a, b in spans)


def test_plan_uses_what_there_is():
    rnd = random.Random(2)
    lengths = [rnd.randrange(1, 4096) for _ in range(3000)]
    hist = {n: lengths.count(n) for n in set(lengths)}
    shapes, counts = packing.plan(hist, 4096)
    have = np.zeros(64)
    for n in lengths:
        have[-(-n // 64) - 1] += 1
    assert (counts @ shapes <= have).all() and counts.sum() > 500 and (shapes @ np.arange(1, 65) == 64).all()
    assert len(packing.plan({}, 4096)[1]) == 0


def test_nnls():
    rnd = np.random.default_rng(0)
    a = rnd.random((6, 9))
    b = rnd.random(6)
    x = packing.nnls(a, b)
    w = a.T @ (b - a @ x)
    assert (x >= 0).all() and (w <= 1e-9).all() and np.allclose(w * x, 0)  # what makes it a minimum
    assert np.allclose(packing.nnls(np.eye(3), np.array([1.0, -1.0, 2.0])), [1, 0, 2])


@given(st.lists(st.binary(max_size=4).map(lambda b: b"x" * 62 + b) | st.binary(max_size=5), max_size=30))
@settings(max_examples=80, deadline=None)
def test_deep_shallow(strings):
    order, lcp = deep_shallow(strings)
    got = [strings[i] for i in order]
    assert got == sorted(strings)
    for i in range(1, len(got)):
        assert lcp[i] == len(list(itertools.takewhile(lambda p: p[0] == p[1], zip(got[i - 1], got[i]))))


@given(st.lists(st.sets(st.integers(1, 25), min_size=1), min_size=2, max_size=12))
@settings(max_examples=200, deadline=None)
def test_linked_equals_all_pairs(sets):
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    root = np.arange(len(sets))
    near_dup.linked(arrays, 60, 100, root)

    def find(p, i):
        while p[i] != i:
            i = p[i]
        return i

    want = list(range(len(sets)))
    for i, j in itertools.combinations(range(len(sets)), 2):
        if 100 * len(sets[i] & sets[j]) >= 60 * len(sets[i] | sets[j]):
            a, b = find(want, i), find(want, j)
            want[max(a, b)] = min(a, b)
    assert [find(root, i) for i in range(len(sets))] == [find(want, i) for i in range(len(sets))]


@pytest.mark.parametrize("bits, width", [(128, 16), (64, 8), (100, 16)])
def test_pigeonhole_finds_all(bits, width):
    rnd = np.random.default_rng(1)
    signs = rnd.integers(0, 2, size=(500, bits)).astype(bool)
    signs[100:200] = signs[7] ^ (rnd.random((100, bits)) < 0.1)
    codes = np.zeros((500, -(-bits // 64) * 8), np.uint8)
    codes[:, : -(-bits // 8)] = np.packbits(signs, axis=1, bitorder="little")
    index = hamming_index.MultiIndex(codes.view(np.uint64), bits, width)
    for r in (0, 3, 8, 24, bits):
        want = np.flatnonzero((signs ^ signs[7]).sum(axis=1) <= r)
        rows, looked = index.within(codes.view(np.uint64)[7], r)
        assert rows.tolist() == want.tolist() and len(rows) <= looked <= 500


@given(st.lists(st.floats(-3, 3), min_size=1, max_size=7), st.lists(st.floats(0, 2), min_size=6, max_size=6))
@settings(max_examples=100, deadline=None)
def test_minimum_cut(scores, weights):
    edges = [(i, i + 1, w) for i, w in zip(range(len(scores) - 1), weights)]

    def cost(label):
        return sum(abs(s) for s, k in zip(scores, label) if k != (s > 0)) + sum(w for a, b, w in edges if label[a] != label[b])

    best = min(cost(x) for x in itertools.product([False, True], repeat=len(scores)))
    assert cost(html_text.minimum_cut(scores, edges)) <= best + 1e-6


PAGE = """<html><head><title>x</title></head><body><div id="cookie-notice"><p>We use cookies.</p></div><header><h1>Site</h1></header><main><article><header><h1>Title &amp; more</h1></header>
<p>First  para with enough words,<br>really.<ul><li>item one</li><li>item two</li></ul><p>short</p><div class="ad"><p>Buy a very nice thing for you and your family</p></div>
<section class="comments"><p>I think this article is wonderful and long enough to look like text.</p></section></article></main><aside class="sidebar"><p>Related long text that is not part of it.</p></aside><form>Search<input></form><footer>f</footer><script>var a="</p>";</script></body></html>"""


def test_main_text():
    assert html_text.main_text(PAGE) == "Title & more\n\nFirst para with enough words, really.\n\nitem one\n\nitem two\n\nshort"
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<") == ""
    html_text.main_text("<a \"" * 2000 + "<!-- " + "<p" * 2000)  # broken markup in linear time


def test_anchors_meet():
    rnd = random.Random(9)
    shared = bytes(rnd.randrange(97, 123) for _ in range(100))
    a, b = b"0" * 150 + shared + b"1" * 90, b"2" * 33 + shared + b"3" * 120
    owner, pos, gram, _ = suffix_dedup.anchors([a, b], 100, 50)
    assert {(p - 150) for o, p in zip(owner, pos) if o == 0 and 150 <= p <= 200} & {(p - 33) for o, p in zip(owner, pos) if o == 1 and 33 <= p <= 83}


@pytest.mark.parametrize("p, common, a, b", [(80, 8, 1, 1), (85, 17, 1, 2)])
def test_links_at_the_similarity_meet(p, common, a, b):
    rnd, sets = np.random.default_rng(11), []
    for _ in range(12_000):
        h = rnd.integers(1 << 63, size=common + a + b, dtype=np.uint64)
        sets += [h[: common + a], np.concatenate([h[:common], h[common + a :]])]
    trees, depth = near_dup.forest(p, 100)
    head, tail = near_dup.signatures(sets, trees, depth)
    same = (head[::2] == head[1::2]) & (tail[::2] == tail[1::2])
    assert (~same.any(axis=1)).sum() <= 2
    assert near_dup.forest(85, 100) == (24, 6)


def test_neighbours_by_region():
    """A region of few classes is joined at its depth, a crowded one deeper; brute force over prefixes."""
    import pyarrow as pa

    rnd, depth, few = np.random.default_rng(5), 6, 4
    values = rnd.integers(0, 2, size=(200, depth))
    values[:, :3] = 0
    pack = lambda v: sum(int(x) << (48 - 16 * i) for i, x in enumerate(v))
    rows = [(int(t), pack(v[:4]), pack(v[4:]), i, 1) for i, (t, v) in enumerate(zip(rnd.integers(0, 9, 200), values))]
    cols = list(zip(*rows))
    batch = pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[1:])], ["tree", "head", "tail", "a", "n"])
    root = list(range(200))
    for out in near_dup.neighbours([batch], depth, few):
        for a, b in zip(*(c.to_pylist() for c in out.columns)):
            root = [root[b] if r == root[a] else r for r in root]
    want, tree = list(range(200)), np.array(cols[0])
    left = set(range(200))
    for d in range(4, depth + 1):
        regions = {}
        for i in left:
            regions.setdefault((tree[i], *values[i, :d]), []).append(i)
        for region in regions.values():
            if len(region) <= few or d == depth:
                for i in region:
                    want[i] = region[0]
                left -= set(region)
    groups = lambda r: {frozenset(i for i in range(200) if r[i] == x) for x in set(r)}
    assert groups(root) == groups(want)


def test_text_of_made_up_pages_by_brute_force():
    """The cut of least cost over all labellings, on pages whose markup leaves blocks open; flow decides some against the classifier."""
    rnd, over, flowed = random.Random(8), 0, 0
    words = "the river. of, owls and seven! oak tree near dusk".split()
    for _ in range(150):
        parts = []
        for _ in range(rnd.randrange(1, 9)):
            tag = rnd.choice(["p", "p", "div", "li", "h2"])
            text = " ".join(rnd.choice(words) for _ in range(rnd.choice([1, 2, 5, 30, 80])))
            parts.append(f"<{tag}>{f'<a href=x>{text}</a>' if rnd.random() < 0.2 else text}</{tag}>")
            if rnd.random() < 0.3:
                parts.append(rnd.choice(["<section>", "</section>", "<div class=story>", "</div>"]))
        page = "".join(parts)
        found = html_text.blocks(page)
        cost, edges = html_text.scores(found, html_text.FALLBACK), html_text.smoothness(found)
        total = lambda label: sum(abs(s) for s, k in zip(cost, label) if k != (s > 0)) + sum(w for a, b, w in edges if label[a] != label[b])  # noqa: E731, B023
        label = html_text.minimum_cut(cost, edges)
        least = min(map(total, itertools.product([False, True], repeat=len(cost))))
        assert abs(total(label) - least) < 1e-6
        assert html_text.main_text(page) == "\n\n".join(t for (t, *_), k in zip(found, label) if k)
        over += sum(k != (s > 0) for s, k in zip(cost, label))
        flowed += total([s > 0 for s in cost]) > least + 1e-6
    assert over > 20 and flowed > 10


def test_lines_within_blocks():
    page = '<article><p>Story <span class="ad">Buy now!</span>goes <span style="display:none">x<span>y</span>z</span>on <math><mi>a</mi><mo>+</mo></math> here.</p><p class="alert-free side-story">More of it.</p><div class="comments"><p>I disagree with all of this, at length.</p></div></article>'
    assert html_text.main_text(page) == "Story goes on a+ here.\n\nMore of it."


def test_classifier_learns_and_falls_back():
    rnd = np.random.default_rng(2)
    x = np.column_stack([np.ones(400), rnd.normal(size=(400, 3))])
    y = x @ [0.2, 2.0, -1.0, 0.0] + rnd.normal(0, 0.3, 400) > 0
    w = html_text.fitted(x, y)
    assert ((x @ w > 0) == y).mean() > 0.93 and html_text.fitted(x[:10], y[:10]) is html_text.FALLBACK
