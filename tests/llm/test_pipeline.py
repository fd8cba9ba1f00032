"""run() of the pipeline against its five stages by brute force, in plain Python."""

import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import regex

import corpus_pipeline
from weftline.llm import quality
from weftline.llm.words import library_tokenizer

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
VOCABULARY = [a + b + c for a in ("ba", "lo", "té", "mi", "su", "kra") for b in ("n", "r", "st", "ll") for c in ("a", "o", "u", "ix", "世")]
CARDS = ["4111 1111 1111 1111", "5500005555555559"]


def prose(rnd, n):
    return " ".join(rnd.choice(VOCABULARY) for _ in range(n))


def made_rows():
    """Prose, copies, near copies at and under the similarity, shared passages that end within characters, personal data, junk, nulls."""
    rnd = random.Random(11)
    texts = [prose(rnd, rnd.randrange(12, 150)) for _ in range(30)]
    base = texts[0] + " " + prose(rnd, 60)
    words = base.split()
    texts += [base, base, base.upper()]
    for changed in (1, 2, 4, 8, 20):
        w = list(words)
        for i in rnd.sample(range(len(w)), changed):
            w[i] = "otra"
        texts.append(" ".join(w))
    passage = prose(rnd, 70)
    texts += [f"{prose(rnd, 40)} {passage} {prose(rnd, 40)}" for _ in range(3)]
    # the shared bytes begin or end within a character: é and è, 世 and 丗 share a byte or more
    texts += [f"{prose(rnd, 20)} é{passage}世 {prose(rnd, 20)}", f"{prose(rnd, 20)} è{passage}丗 {prose(rnd, 20)}", f"{prose(rnd, 20)} é{passage}世 {prose(rnd, 20)}"]
    texts += [f"{prose(rnd, 15)} mail a.b@c.example.com or +1 (212) 555-1234 , {prose(rnd, 8)} 10.0.0.1 , {CARDS[0]} {prose(rnd, 9)}", f"{prose(rnd, 30)} 300.1.1.1 , {CARDS[1]} x@y", f'{prose(rnd, 25)} token = "04deadbeef04deadbeef04" {prose(rnd, 12)}']
    texts += ["### *** $$$ " * 12, "!!! ??? " * 30, "123 456 7890 " * 9, f"{prose(rnd, 9)}\n" * 8, "", None, " \n ", "too short", "x" * 9000, prose(rnd, 6000)]
    # junk that holds the base rules, so that only the posterior can reject it
    texts += [" ".join(f"{rnd.choice('#*$%')}{rnd.randrange(10**6)}!!??" for _ in range(25)) for _ in range(4)]
    return [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)] + [(None, base, None, None, None), (None, prose(rnd, 50), None, None, None), (31, base, "en", "s", 0)]


def counts(text):
    text = text or ""
    w, solid = WORD.findall(text), "".join(WORD.findall(text))
    windows = defaultdict(list)
    for i in range(len(w) - 4):
        windows[tuple(w[i : i + 5])].append(i)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    among = lambda chars: sum(c in chars for c in solid)
    return {
        "n": len(w),
        "chars": len(solid),
        "symbols": among("#*$%&|<>"),
        "lines": len(lines),
        "dup_lines": len(lines) - len(set(lines)),
        "repeats": len({j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 5)}),
        "distinct": len(set(w)),
        "upper": among("ABCDEFGHIJKLMNOPQRSTUVWXYZÀÂÄÇÉÈÊËÍÎÏÑÓÔÖÙÚÛÜŒ"),
        "digits": among("0123456789"),
        "shout": among("!?"),
        "formed": sum(bool(regex.fullmatch(r"[\"'(«¿¡]?[\p{L}\p{M}]+(?:['’-][\p{L}\p{M}]+)?[.,;:!?)\"'»]?", x)) for x in w),
    }


def cast_votes(c):
    """0 for bad, 1 for an abstention, 2 for good, rule by rule, in the operator's order. For texts with ten words or more."""
    n, chars = c["n"], c["chars"]

    def by(share, bad, good):
        return 0 if share > bad else 2 if share < good else 1

    form, mean, variety = c["formed"] / n, chars / n, c["distinct"] / n
    return [
        0 if form < 0.75 else 2 if form > 0.9 else 1,
        0 if n < 10 else 2 if n >= 50 else 1,
        by(c["symbols"] / n, 0.1, 0.02),
        by(c["dup_lines"] / c["lines"], 0.3, 0.05),
        by(c["repeats"] / n, 0.2, 0.05),
        0 if mean < 2 or mean > 14 else 2 if 3 <= mean <= 10 else 1,
        by(c["upper"] / chars, 0.4, 0.15),
        by(c["shout"] / n, 0.2, 0.05),
        by(c["digits"] / chars, 0.3, 0.1),
        0 if n >= 50 and variety < 0.1 else 2 if variety > (0.3 if n < 2000 else 0.1) else 1,
    ]


def posteriors(votes):
    """Expectation-maximisation document by document; the chance that each is good."""
    v = np.eye(3)[np.array(votes)]  # document, rule, vote
    n, rules, _ = v.shape
    lean = n * quality.WEIGHT / 100
    share, good, bad = quality.BAD_SHARE, np.tile(quality.ON_GOOD, (rules, 1)), np.tile(quality.ON_BAD, (rules, 1))

    def p_bad():
        odds = (v * np.log(bad)).sum(axis=(1, 2)) + math.log(share) - (v * np.log(good)).sum(axis=(1, 2)) - math.log(1 - share)
        return 1 / (1 + np.exp(-odds))

    for _ in range(25):
        b = p_bad()
        share = (b.sum() + lean * quality.BAD_SHARE) / (n + lean)
        good = (np.einsum("d,drv->rv", 1 - b, v) + lean * np.array(quality.ON_GOOD)) / ((1 - b).sum() + lean)
        bad = (np.einsum("d,drv->rv", b, v) + lean * np.array(quality.ON_BAD)) / (b.sum() + lean)
        good[:, 0] = np.minimum(good[:, 0], quality.FALSE_ALARMS)
        bad[:, 0] = np.maximum(bad[:, 0], quality.HITS)
    return 1 - p_bad()


def good_rows(rows):
    """Rows that pass the base rules, with the chance that each is good."""
    sound = [(r, c) for r, c in ((r, counts(r[1])) for r in rows) if c["n"] >= 10 and 100 * c["repeats"] <= 20 * c["n"]]
    return [(r, p) for (r, _), p in zip(sound, posteriors([cast_votes(c) for _, c in sound]))]


def without_copies(rows):
    """One of each group, the one with the smallest doc_id: five-word shingles, 0.8."""
    sets = []
    for r in rows:
        w = WORD.findall(r[1].translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [b if x == a else x for x in root]
    groups = defaultdict(list)
    for r, g in zip(rows, root):
        groups[g].append(r)
    return [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]


def without_repeats(rows):
    """doc_id, text without the bytes that a string of 100 covers which starts earlier too; a character that loses a byte goes."""
    seen, out = set(), []
    for key, text, *_ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        b = text.encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 99):
            if b[i : i + 100] in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(b[i : i + 100])
        at, kept = 0, []
        for ch in text:
            size = len(ch.encode())
            if not any(gone[at : at + size]):
                kept.append(ch)
            at += size
        out.append((key, "".join(kept)))
    return out


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


KINDS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m, d: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m, d: all(int(x) <= 255 for x in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m, d: 13 <= len(d) <= 19 and luhn(d)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m, d: 9 <= len(d) <= 15),
}


def redacted(text):
    """Base spans and assigned literals as their kinds; no word has enough known instances after it to be a context."""
    spans = [(m.start(), m.end(), k) for k, (p, ok) in KINDS.items() for m in re.finditer(p, text) if ok(m[0], re.sub("[^0-9]", "", m[0]))]
    spans += [(*m.span(1), "context") for m in re.finditer(r"""= ["']([0-9A-Za-z_/+=.-]{20,})["']""", text)]
    at, out = 0, []
    for start, end, kind in sorted(spans):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def ids_of(text):
    return (*library_tokenizer(P.path("word_bpe_49k.json")).encode(text, add_special_tokens=False).ids, 2)


def test_posterior_equals_brute_force(spark):
    rows = made_rows()
    got = quality.judged(spark.createDataFrame(rows, SCHEMA).repartition(3)).select("doc_id", "n_words", "p_good", "base_failed").collect()
    want = sorted((r[0] if r[0] is not None else -1, counts(r[1])["n"], p) for r, p in good_rows(rows))
    mine = sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.p_good) for r in got if not r.base_failed)
    assert [x[:2] for x in mine] == [x[:2] for x in want]
    assert np.allclose([x[2] for x in mine], [x[2] for x in want], rtol=1e-9, atol=1e-12)


def test_run_equals_brute_force(spark, tmp_path):
    rows = made_rows()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    kept = without_copies([r for r, p in good_rows(rows) if p >= 0.5])
    cut = without_repeats(kept)
    texts = {key: redacted(text) for key, text in cut}
    # each stage has something to do here, and the decisions of all of them show in the ids
    assert 0 < len(kept) < len([r for r, p in good_rows(rows) if p >= 0.5]) < len(good_rows(rows)) < len(rows)
    assert sum(len(t) for _, t in cut) < sum(len(r[1]) for r in kept)
    assert all(any(f"[{k}]" in t for t in texts.values()) for k in ("EMAIL", "IP", "CARD", "PHONE", "CONTEXT"))

    want = {key: ids_of(text) for key, text in texts.items()}
    assert len(want) == len(kept)
    pieces, places = defaultdict(list), defaultdict(list)
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        ids = want[r.doc_id]
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.asarray(ids[r.start : r.start + r.length], "<u4").tobytes())
        pieces[r.doc_id].append((r.start, r.length))
        places[r.sequence_id].append((r.offset, r.length))
    assert pieces.keys() == want.keys()
    for spans, whole in [(pieces[k], len(want[k])) for k in want] + [(p, None) for p in places.values()]:
        at = 0
        for start, length in sorted(spans):
            assert start == at and length > 0
            at += length
        assert at == whole if whole is not None else at <= 4096


def test_run_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
