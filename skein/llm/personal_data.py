"""Personal data by weak supervision.

Base spans (email, ip, card, phone) are exact patterns and always stay.  Looser
candidates (disguised emails, local phone numbers, social security numbers,
account numbers) are voted on by four labelers: a format check, a gazetteer, the
words before, and the characters around.  Expectation-maximisation over the counts
of vote patterns of the whole corpus estimates each labeler's reliability.  A
logistic classifier, trained on its posteriors, decides by the votes and by what
the labelers do not look at: length, share of digits, the separator inside, and
whether a word of the kind stands behind.  There are at most
8 * 3^4 * 4 * 4 * 6 * 2 patterns whatever the corpus holds, so the counts that reach
the driver are bounded, and all spans are in them.

Defined results: null texts count as empty; repeated rows give repeated results
and count as often as they stand; extra columns are ignored; an empty table, or
one without candidates, trains nothing and adds nothing.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exprs import text_of
from .scratch import Scratch

BASE = ("email", "ip", "card", "phone")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_TAIL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
EXTRA = (
    ("email_disguised", re.compile(r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{2,64} ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]{2,63}(?: ?[\[(](?:dot|DOT)[\])] ?[A-Za-z]{2,24}){1,3}")),
    ("phone_local", re.compile(r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])")),
    ("ssn", re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")),
    ("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")),
)
ORDER = {k: i for i, k in enumerate([*BASE, *(k for k, _ in EXTRA)])}
# Common top-level domains, telephone country codes, first digits of card issuers, and countries of account numbers.
DOMAINS = frozenset(
    """com net org edu gov mil int info biz io co me app dev ai tv cc xyz online site tech cloud eu us uk ca au nz ie de fr es it pt nl be
    ch at se no dk fi pl cz sk hu ro bg gr tr ru ua jp cn kr tw hk sg in id my th vn ph br ar cl mx pe za ng ke eg il ae sa""".split()
)
CALL_CODES = tuple(
    """1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98
    212 213 216 218 220 221 225 229 233 234 237 243 244 249 251 254 255 256 260 263 351 352 353 354 355 356 357 358 359 370 371 372 373 374 375
    376 377 380 381 385 386 387 389 420 421 423 502 503 504 505 506 507 509 591 593 595 598 852 853 855 880 886 961 962 963 964 965 966 968 971
    972 973 974 977 992 994 995 996 998""".split()
)
ISSUERS = ("2", "30", "34", "35", "36", "37", "38", "4", "50", "51", "52", "53", "54", "55", "56", "58", "6011", "62", "63", "64", "65", "67")
IBAN_COUNTRIES = frozenset("AD AE AL AT AZ BA BE BG BH BR CH CR CY CZ DE DK EE ES FI FO FR GB GE GI GL GR HR HU IE IL IS IT KW KZ LB LI LT LU LV MC MD ME MK MT NL NO PL PT QA RO RS SA SE SI SK SM TN TR UA".split())
HINTS = {
    "email": "email mail e-mail contact write courriel correo".split(),
    "phone": "phone tel call fax mobile telephone telefon telefono téléphone cell".split(),
    "card": "card visa mastercard credit carte tarjeta karte payment".split(),
    "ip": "ip host server address from addr login".split(),
    "ssn": "ssn social security".split(),
    "iban": "iban account konto compte cuenta bank".split(),
}
AGAINST = frozenset("version isbn issn order part item page figure section doi ref invoice".split())
WORDS_BEFORE = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def base_spans(t: str) -> list[tuple[int, int, str, int]]:
    """(start, order, kind, end) of all base spans, sorted."""
    out = []
    done, at = 0, t.find("@")
    while at >= 0:
        # the leftmost match starts where the run of local characters before the @ does
        left = at
        while left > done and LOCAL.match(t, left - 1):
            left -= 1
        m = DOMAIN.match(t, at + 1) if left < at else None
        if m:
            out.append((left, 0, "email", m.end()))
            done = m.end()
        # characters passed once are not passed again: nothing left of this @ can belong to a later match
        done = max(done, at + 1)
        at = t.find("@", done)
    if DIGIT.search(t):
        for m in IP.finditer(t):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, "ip", m.end()))
        for m in CARD.finditer(t):
            d = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), 2, "card", m.end()))
        for m in PHONE.finditer(t):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), 3, "phone", m.end()))
    return sorted(out)


def overlaps(start: int, end: int, taken: list[tuple[int, int]]) -> bool:
    i = bisect_right(taken, (start, end))
    return (i > 0 and taken[i - 1][1] > start) or (i < len(taken) and taken[i][0] < end)


def extra_spans(t: str, base: list[tuple[int, int, str, int]]) -> list[tuple[int, int, str, int]]:
    """Candidates outside all base spans."""
    ends: list[tuple[int, int]] = []
    for s, _, _, e in base:
        if ends and s < ends[-1][1]:
            ends[-1] = (ends[-1][0], max(e, ends[-1][1]))
        else:
            ends.append((s, e))
    out = []
    digits = bool(DIGIT.search(t))
    for kind, pattern in EXTRA:
        if kind == "email_disguised" and "at" not in t and "AT" not in t or kind != "email_disguised" and not digits:
            continue
        out += [(m.start(), ORDER[kind], kind, m.end()) for m in pattern.finditer(t) if not overlaps(m.start(), m.end(), ends)]
    return out


def iban_ok(s: str) -> bool:
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def votes(t: str, start: int, kind: str, end: int) -> str:
    """kind|votes|shape; a vote is 1, 0 or - (abstains), the shape has a digit each for length, digits, separator and words behind."""
    s = t[start:end]
    d = "".join(c for c in s if c in "0123456789")
    family = kind.split("_")[0]
    if family == "email":
        form = "1" if s.rsplit(".", 1)[-1].isalpha() or kind != "email" else "0"
        top = re.split(r"[.\s\])]+", s.rstrip("])"))[-1].lower()
        known = "1" if top in DOMAINS else "0"
    elif family == "ip":
        form = "0" if s.startswith("0") else "1"
        known = "0" if s.startswith(("127.", "10.", "192.168.")) else "-"
    elif family == "card":
        form = "1" if len(d) in (14, 15, 16, 19) else "0"
        known = "1" if d.startswith(ISSUERS) else "-"
    elif kind == "phone":
        form, known = "1", "1" if d.startswith(CALL_CODES) else "0"
    elif kind == "phone_local":
        form, known = "1" if d[0] not in "01" and d[3] not in "01" else "0", "-"
    elif kind == "ssn":
        form, known = "1" if d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000" else "0", "-"
    else:
        form, known = "1" if iban_ok(s) else "0", "1" if s[:2] in IBAN_COUNTRIES else "0"
    before = [w.lower() for w in WORDS_BEFORE.findall(t[max(0, start - 40) : start])[-4:]]
    context = "1" if any(w in HINTS[family] for w in before) else "0" if any(w in AGAINST for w in before) else "-"
    around = (t[start - 1] if start else " ") + (t[end] if end < len(t) else " ")
    edge = "0" if any(c.isalnum() or c in "_/=" for c in around) else "1"
    between = "".join(c for c in s if not c.isalnum())
    separator = 0 if not between else 5 if len(set(between)) > 1 else " .-(".find(between[0]) + 1
    behind = int(any(w.lower() in HINTS[family] for w in WORDS_BEFORE.findall(t[end : end + 30])[:3]))
    shape = f"{min(3, len(s) // 10)}{min(3, 4 * len(d) // len(s))}{separator}{behind}"
    return f"{kind}|{form}{known}{context}{edge}|{shape}"


def scan_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        counts, shas, spans = [], [], []
        for t in b["text"]:
            base = base_spans(t)
            more = extra_spans(t, base)
            counts.append([sum(k == kind for _, _, k, _ in base) for kind in BASE])
            joined = ",".join(f"{k}:{s}:{e}" for s, _, k, e in base)
            shas.append(hashlib.sha256(joined.encode()).hexdigest())
            spans.append([{"start": s, "ord": o, "kind": k, "end": e, "votes": votes(t, s, k, e)} for s, o, k, e in sorted(base + more)])
        out = pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), **{f"n_{k}": [c[i] for c in counts] for i, k in enumerate(BASE)}, "base_sha256": shas})
        out["spans"] = spans
        yield out


SCAN = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans array<struct<start:long,ord:int,kind:string,end:long,votes:string>>"


def em(patterns: dict[str, int], rounds: int = 50) -> tuple[dict[str, float], np.ndarray]:
    """Posterior of each pattern, and P(vote | class) by labeler, class, vote (0, 1, abstain)."""
    keys = sorted(patterns)
    kinds = sorted({k.split("|")[0] for k in keys})
    n = np.array([patterns[k] for k in keys], float)
    kind_at = np.array([kinds.index(k.split("|")[0]) for k in keys])
    v = np.array([["01-".index(c) for c in k.split("|")[1]] for k in keys])
    post = np.clip((v == 1).sum(1) / np.maximum(1, (v != 2).sum(1)), 0.05, 0.95)
    table = np.zeros((v.shape[1], 2, 3))
    for _ in range(rounds):
        prior = np.array([(1 + (n * post)[kind_at == i].sum()) / (2 + n[kind_at == i].sum()) for i in range(len(kinds))])
        for j in range(v.shape[1]):
            for c, w in ((0, n * (1 - post)), (1, n * post)):
                got = np.array([w[v[:, j] == x].sum() for x in range(3)]) + np.array([1.0, 2.0, 1.0] if c else [2.0, 1.0, 1.0])
                table[j, c] = got / got.sum()
        like = np.ones((len(keys), 2))
        for j in range(v.shape[1]):
            like *= table[j][:, v[:, j]].T
        like *= np.stack([1 - prior[kind_at], prior[kind_at]], 1)
        post = like[:, 1] / like.sum(1)
    return dict(zip(keys, post, strict=True)), table


def features(key: str) -> np.ndarray:
    kind, vote, shape = key.split("|")
    sizes = (len(ORDER), *[3] * len(vote), 4, 4, 6, 2)
    at = (ORDER[kind], *["01-".index(c) for c in vote], *map(int, shape))
    x = np.zeros(1 + sum(sizes))
    x[0] = 1
    x[1 + np.cumsum((0, *sizes[:-1])) + np.array(at)] = 1
    return x


def train(patterns: dict[str, int], rounds: int = 300, ridge: float = 1e-2) -> dict[str, float]:
    """Probability of each pattern by a logistic classifier trained on the posteriors, weighted by their counts."""
    if not patterns:
        return {}
    post, _ = em(patterns)
    keys = sorted(patterns)
    x = np.stack([features(k) for k in keys])
    w = np.array([patterns[k] for k in keys], float)
    y = np.array([post[k] for k in keys])
    theta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        grad = x.T @ (w * (p - y)) + ridge * w.sum() * theta / len(theta)
        hess = (x.T * (w * np.maximum(p * (1 - p), 1e-6))) @ x + (1e-3 + ridge * w.sum() / len(theta)) * np.eye(len(theta))
        step = np.linalg.solve(hess, grad)
        theta -= step
        if np.abs(step).max() < 1e-8:
            break
    p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
    return dict(zip(keys, p.tolist(), strict=True))


def scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInPandas(scan_batches, SCAN)


def accepted(scanned: DataFrame, at_least: float = 0.5) -> list[str]:
    """Vote patterns of extra spans that the classifier accepts."""
    rows = scanned.select(F.explode("spans.votes").alias("v")).groupBy("v").agg(F.count("*").alias("n")).collect()
    p = train({r["v"]: r["n"] for r in rows})
    return sorted(k for k, x in p.items() if x >= at_least and k.split("|")[0] not in BASE)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base counts and digest, and ``spans``: base ones and accepted others."""
    scanned = Scratch(docs.sparkSession, "personal-data").write(scan(docs, id_col, text_col))
    good = accepted(scanned)
    keep = lambda s: s["kind"].isin(list(BASE)) | s["votes"].isin(good or [""])
    return scanned.withColumn("spans", F.filter("spans", keep))


def redact_text(t: str, good: frozenset[str]) -> str:
    """The text with each span replaced by its kind in angle brackets; of overlapping spans the first, then the longest."""
    base = base_spans(t)
    spans = base + [x for x in extra_spans(t, base) if votes(t, x[0], x[2], x[3]) in good]
    out, done = [], 0
    for s, o, kind, e in sorted(spans, key=lambda x: (x[0], -x[3], x[1])):
        if s >= done:
            out += [t[done:s], f"<{kind}>"]
            done = e
        elif e > done:
            done = e
    return "".join([*out, t[done:]]) if out else t


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with personal data in ``text_col`` replaced; nulls stay null."""
    scratch = Scratch(docs.sparkSession, "personal-data")
    patterns = scratch.write(scan(docs, id_col, text_col).select(F.explode("spans.votes").alias("v")).groupBy("v").agg(F.count("*").alias("n")))
    p = train({r["v"]: r["n"] for r in patterns.collect()})
    good = frozenset(k for k, x in p.items() if x >= 0.5 and k.split("|")[0] not in BASE)

    @F.pandas_udf("string")
    def clean(ts: pd.Series) -> pd.Series:
        return ts.map(lambda t: t if t is None else redact_text(t, good))

    return docs.withColumn(text_col, clean(F.col(text_col).cast("string")))


def query(spark, sf_dir: str) -> DataFrame:
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    joined = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", joined.alias("spans"))
