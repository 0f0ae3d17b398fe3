"""Each stage of the pipeline against a brute-force version, over small tables with nulls, ties, repeats and clashing columns."""

import hashlib
import random
import re
from collections import Counter

import corpus_pipeline as P
import numpy as np
import pytest

from skein.llm import byte_bpe, near_dedup, quality_rules

from test_free_ops import brute_classes, brute_pii, prose

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
STAGE = dict(P.STAGES)


def frame(spark, rows, extra=False):
    if extra:
        return spark.createDataFrame([(*r, "x", 1, "y", "z") for r in rows], SCHEMA + ", m string, kept int, _md5 string, label string")
    return spark.createDataFrame(rows, SCHEMA)


def plain(df):
    assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    return sorted((tuple(r) for r in df.collect()), key=str)


def brute_quality(t):
    t = t or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    m = {
        "n_words": len(words), "n_lines": len(lines), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", t)), "n_dup_lines": len(lines) - len(set(lines)),
        "n_stop_words": sum(w.strip(quality_rules.MARKS).lower() in set(quality_rules.stop_words()) for w in words), "n_letter_words": sum(any(c.isalpha() for c in w) for w in words),
        "n_bullet_lines": sum(bool(re.match(r"\s*[-*•]\s", x)) for x in lines), "n_ellipsis_lines": sum(bool(re.search(r"(?:\.\.\.|…)\s*$", x)) for x in lines),
    }
    if len(words) < 50 or 100 * len(covered) > 50 * len(words):
        return False
    for r in quality_rules.RULES:
        x, per = m[r.metric] * 1000, m[r.per]
        if (r.low is not None and x < r.low * per) or (r.high is not None and x > r.high * per):
            return False
    return True


def test_quality(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    rows = [tuple(r) for r in docs.collect()] + [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "x" * 9000, "en", "s", 9000)]
    got = plain(P.quality(spark, frame(spark, rows, extra=True), ""))
    assert got == sorted((r for r in rows if brute_quality(r[1])), key=str) and 50 < len(got) < len(rows)


def dedup_rows():
    rng = random.Random(3)
    a, b, c, d = (prose(rng, 70) for _ in range(4))
    near = a.split()
    near[5] = near[40] = "changed"
    rows = [
        (1, a, "en", "s", 1), (1, b, "en", "s", 1), (1, c, "en", "s", 1), (2, " ".join(near), "en", "s", 1), (3, d, "fr", None, 2), (3, d, "fr", None, 2), (3, d, None, "s", 2),
        (None, d, "en", "s", 9), (None, c + " more", "en", "s", 1), (None, "alone words", "en", "s", 1), (None, "alone words", "de", "s", 1), (7, None, "en", "s", 0), (8, "", "en", "s", 0),
    ]
    return rows


def test_dedup(spark):
    """One row of each class, whatever the order; no class goes, and different texts under one id are classes of their own."""
    rows = dedup_rows()
    want_classes = brute_classes([r[1] or "" for r in rows])
    outs = []
    for seed in (0, 1):
        order = rows[:]
        random.Random(seed).shuffle(order)
        outs.append(plain(P.dedup(spark, frame(spark, order, extra=True), "").repartition(1)))
    assert outs[0] == outs[1]
    kept = outs[0]
    assert len(kept) == len(set(want_classes)) and set(kept) <= set(rows)
    by_row = {str(r): k for r, k in zip(rows, want_classes, strict=True)}
    assert len({by_row[str(r)] for r in kept}) == len(kept)
    # of repeated rows the one of least (source, lang, n_chars), nulls first; an id wins over none
    assert (3, d_text(rows), "fr", None, 2) in kept and not any(r[0] is None and r[1] == d_text(rows) for r in kept)


def d_text(rows):
    return next(r[1] for r in rows if r[0] == 3)


def redacted(t):
    if t is None:
        return None
    out, done = "", 0
    for s, o, kind, e in sorted(brute_pii(t), key=lambda x: (x[0], -x[3], x[1])):
        if s >= done:
            out += t[done:s] + f"<{kind}>"
            done = e
        else:
            done = max(done, e)
    return out + t[done:]


def test_private(spark):
    rng = random.Random(8)
    parts = ["mail a.b@c.org now", "from 10.1.2.3 on", "card 4111 1111 1111 1111.", "call +44 20 7946 0958 x", "plain words", "é"]
    rows = [(i, " ".join(rng.choice(parts) for _ in range(rng.randrange(5))), "en", "s", -1) for i in range(60)] + [(None, None, "en", "s", None), (5, "", None, None, 0)]
    got = plain(P.private(spark, frame(spark, rows, extra=True), ""))
    want = [(i, redacted(t), lang, s, None if t is None else len(redacted(t))) for i, t, lang, s, _ in rows]
    assert got == sorted(want, key=str)


def test_mix(spark):
    """Only rows of the table, repeated up to three times each, as many words a source as its target to half a row."""
    rng = random.Random(6)
    rows = [(i, "w " * rng.randrange(1, 9), "en", "abc"[i % 3] if i % 10 else None, 5) for i in range(240)] + [(900, "q " * 6, "en", "a", 1)] * 30 + [(None, None, None, "b", None)]
    got = [tuple(r) for r in P.mix(spark, frame(spark, rows, extra=True), "").collect()]
    n_in, n_out = Counter(rows), Counter(got)
    assert set(n_out) <= set(n_in) and all(n <= 3 * n_in[r] for r, n in n_out.items())
    size, words = Counter(), Counter()
    for r in rows:
        size[r[3]] += len((r[1] or "").split())
    for r in got:
        words[r[3]] += len((r[1] or "").split())
    names = [*sorted(x for x in size if x), None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    fixed, total = {}, sum(size.values())
    while True:
        free = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * size[s]]
        if not over:
            break
        fixed |= {s: 3 * size[s] for s in over}
    for s in names:
        assert abs(words[s] - fixed.get(s, share.get(s))) <= 4.5, (s, words[s], fixed, share)


def test_encode(spark):
    rows = [(1, "I'll don't 中文 \n\n x", "en", "s", 1), (1, "other", "en", "s", 1), (None, None, None, None, None), (2, "w é " * 12_000, "en", "s", 1)]
    got = {(r["doc_id"], r["n_tokens"]): r for r in P.encode(spark, frame(spark, rows, extra=True), "").collect()}
    enc = byte_bpe.encoding(byte_bpe.vocabulary_path())
    for i, t, *_ in rows:
        ids = enc.encode_ordinary(t or "")
        r = got[i, len(ids)]
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and r["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert len(got) == len(rows)


@pytest.mark.parametrize("name", [n for n, _ in P.STAGES])
def test_empty(spark, name):
    assert STAGE[name](spark, frame(spark, []), "").count() == 0


def test_run_is_its_stages(spark, tmp_path):
    """run() on a whole table: what passes each stage by brute force is what is encoded."""
    rng = random.Random(1)
    texts = [" ".join("the" if k % 6 == 0 else w for k, w in enumerate(prose(rng, 80).split())) for _ in range(8)]
    rows = [(i, t, "en", f"s{i % 2}", len(t)) for i, t in enumerate(texts)] + [(20, texts[0], "en", "s1", 1), (21, "too short", "en", "s0", 1), (22, texts[1] + " a@b.org", "en", "s0", 1), (23, None, "en", "s0", None)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    good = [r for r in rows if brute_quality(r[1])]
    label = brute_classes([r[1] for r in good])
    least = {}
    for r, k in zip(good, label, strict=True):
        least[k] = min(least.get(k, r), r, key=lambda x: x[0])
    got = {r["doc_id"] for r in P.run(spark, str(tmp_path)).collect()}
    assert got <= {r[0] for r in least.values()} and len(got) >= 4 and {20, 21, 22, 23} & got == set()
    assert near_dedup.THRESHOLD == 0.8
