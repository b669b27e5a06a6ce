"""PII: base patterns, and a skip-chain conditional random field that carries their labels across a document.

Tokens are mentions that could be personal data: numbers with their separators, and words around an
at sign. Neighbouring tokens are linked in a chain; distant tokens with the same or similar content
are linked by skip edges, so a number that the patterns know in one place is also known where it is
written differently. Loopy sum-product messages give each token's label; tokens inside base spans are
fixed to their kind. Node, chain and skip potentials are fitted piece by piece to the labels of the
base patterns: their statistics are counts, which Spark sums over every document.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Fixed values of the contract: kinds in their order, patterns, and lengths in digits.
KINDS = ("email", "ip", "card", "phone")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
CARD_DIGITS, PHONE_DIGITS = (12, 19), (9, 15)
#: Most rounds of messages, the change that ends them, their damping, the least probability of an added span.
ROUNDS, SETTLED, DAMPING, CERTAIN = 30, 1e-4, 0.3, 0.85
#: Bounds of potentials: patterns can't name what is written differently, so an agreement must be able to overrule a token's own looks.
MAX_NODE, MIN_SKIP, MAX_SKIP, MAX_CHAIN = 4.0, 6.0, 8.0, 1.0
#: Digits that two numbers must end in alike to be similar.
SIMILAR_DIGITS = 8
#: Share of a skip edge's potential between similar numbers, and between mail names at different places.
SIMILAR_NUMBER, SIMILAR_MAIL = 0.8, 0.5
#: Digits from which equal plain numbers are linked; shorter ones repeat by chance.
LEAST_DIGITS = 6
#: Texts without a match have no token.
HAS_TOKEN = r"[0-9@]|[(\[]at[)\]]"
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
# The lookbehinds only spare attempts that would fail from inside the same run, so long runs cost linear time.
_IP_FROM_RUN = re.compile(r"(?<![0-9])" + IP.pattern)
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(EMAIL.pattern.partition("@")[2])
#: A mention of an address: two runs without a delimiter around a sign for at, with signs for dot behind.
_IN_RUN = r"[^\s<>,;\"']"
_MAIL = re.compile(rf"{_IN_RUN}+(?:@| ?[(\[]at[)\]] ?){_IN_RUN}+(?: ?[(\[]dot[)\]] ?{_IN_RUN}+)*")
_AT_SIGN = re.compile(r"@| ?[(\[]at[)\]]")
_DELIMITER = re.compile(r"[\s<>,;\"']")
#: A mention of a number from its first digit on: groups with few signs between them.
_NUMBER = re.compile(r"[0-9](?:[().-]*[\x20./()-]?[(+]?[0-9])*")
_AT, _DOT = re.compile(r" ?[(\[]at[)\]] ?"), re.compile(r" ?[(\[]dot[)\]] ?")
#: Digits of one unbroken group from which a blank beside it parts two numbers: no kind writes such a group and goes on.
WHOLE_GROUP = 7
_GROUP = re.compile(r"[0-9]+")
N_LABELS = len(KINDS) + 1  # label 0 is none


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def _emails(text: str) -> list[tuple[int, int, int]]:
    """What EMAIL.finditer finds, from at sign to at sign: its own scan is quadratic in long runs."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, 0, m.end()))
        done = m.end() if m else at + 1
        at = text.find("@", done)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the base patterns, by start, then kind."""
    out = []
    if "@" in text:
        out += _emails(text)
    if _DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP_FROM_RUN.finditer(text) if all(map(_small, m[0].split(".")))]
        for m in CARD.finditer(text):
            digits = _NOT_DIGIT.sub("", m[0])
            if CARD_DIGITS[0] <= len(digits) <= CARD_DIGITS[1] and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if PHONE_DIGITS[0] <= len(_NOT_DIGIT.sub("", m[0])) <= PHONE_DIGITS[1]:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


# ---------------------------------------------------------------- the field


@dataclass
class Field:
    """Tokens of a document with features, fixed labels, and weighted edges."""

    starts: list[int]
    ends: list[int]
    x: np.ndarray
    fixed: np.ndarray
    chain: list[tuple[int, int]]
    skips: list[tuple[int, int, float]]
    alone: list[bool]


FEATURE_NAMES = (
    "bias", "at", "at_dot", "hidden_at", "d1_3", "d4_8", "d9_11", "d12_15", "d16_19", "d20", "plus", "three_dots", "four_small", "luhn",
    "separated", "plain", "in_word",
)


def _features(token: str, digits: str, in_word: bool) -> tuple[bool, ...]:
    n, mail = len(digits), "@" in token
    at = mail or bool(_AT.search(token))
    parts = token.split(".")
    dots = len(parts) == 4 and all(p.isdigit() for p in parts)
    return (
        True, mail, mail and "." in token.rsplit("@", 1)[1].strip("."), at and not mail,
        not at and n <= 3, not at and 4 <= n <= 8, not at and 9 <= n <= 11, not at and 12 <= n <= 15, not at and 16 <= n <= 19, n >= 20,
        token.startswith("+"), dots, dots and all(map(_small, parts)), not at and CARD_DIGITS[0] <= n <= CARD_DIGITS[1] and luhn(digits),
        not at and n != len(token), not at and n == len(token), in_word,
    )


def _parts(text: str, start: int, end: int, ends_of_spans: list[int]) -> list[tuple[int, int]]:
    """The numbers of a number token: cut at a blank beside a long group of digits, and where a base span ends or begins."""
    cuts, groups = [], [(m.start(), m.end()) for m in _GROUP.finditer(text, start, end)]
    for (a, b), (c, d) in zip(groups, groups[1:]):
        if " " in text[b:c] and (b - a >= WHOLE_GROUP or d - c >= WHOLE_GROUP):
            cuts.append((b, c))
    # A cut at a span keeps what stands before it and after it as numbers of their own.
    for at in ends_of_spans:
        if start < at < end:
            cuts.append((at, at))
    out, at = [], start
    for b, c in [*sorted(set(cuts)), (end, end)]:
        if b > at:
            out.append((at, b))
        at = max(at, c)
    trimmed = []
    for a, b in out:
        while a < b and not (text[a] in "+(" or "0" <= text[a] <= "9"):
            a += 1
        while a < b and not "0" <= text[b - 1] <= "9":
            b -= 1
        if a < b:
            trimmed.append((a, b))
    return trimmed


def _mails(text: str) -> Iterator[tuple[int, int]]:
    """Mentions of addresses, each looked for only around a sign for at."""
    done = 0
    for sign in _AT_SIGN.finditer(text):
        start = sign.start()
        if start < done:
            continue
        while start > done and not _DELIMITER.match(text[start - 1]):
            start -= 1
        m = _MAIL.match(text, start) if start < sign.start() else None
        if m:
            done = m.end()
            yield start, start + len(m[0].rstrip(".:!?)"))


def _tokens(text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, bool, bool]]:
    """(start, end, is mail, stood alone) of the mentions of a text in order; numbers lie between mails."""
    edges, at = sorted({x for a, _, b in spans for x in (a, b)}), 0
    done = 0
    for mail in [*_mails(text), (len(text), len(text))]:
        for m in _NUMBER.finditer(text, done, mail[0]):
            start, end = m.span()
            for sign in "(+":
                start -= start > done and text[start - 1] == sign
            while at < len(edges) and edges[at] <= start:
                at += 1
            inside = at
            while inside < len(edges) and edges[inside] < end:
                inside += 1
            parts = _parts(text, start, end, edges[at:inside])
            for a, b in parts:
                yield a, b, False, len(parts) == 1
        if mail[0] < mail[1]:
            yield *mail, True, True
        done = mail[1]


def build_field(text: str, spans: list[tuple[int, int, int]]) -> Field | None:
    """The field over a text, or None without tokens.

    Mentions with one content are linked to one of them, the first that a base span covers or else
    the first, so edges are no more than tokens and every mention is two steps from any other.
    """
    starts, ends, rows, keys, alone = [], [], [], [], []
    for a, b, mail, whole in _tokens(text, spans):
        token = text[a:b]
        if mail:
            key, digits = "m" + _DOT.sub(".", _AT.sub("@", token)).lower(), ""
        else:
            digits = _NOT_DIGIT.sub("", token)
            short_ip = len(digits) < LEAST_DIGITS and token.count(".") == 3 and all(p.isdigit() for p in token.split("."))
            key = "i" + token if short_ip else "n" + digits
        in_word = not mail and ((a > 0 and text[a - 1].isalnum()) or (b < len(text) and text[b].isalnum()))
        starts.append(a)
        ends.append(b)
        rows.append(_features(token, digits, in_word))
        keys.append(key)
        alone.append(whole)
    if not starts:
        return None
    fixed = np.full(len(starts), -1)
    at = 0
    for a, k, b in sorted(spans, key=lambda s: (s[0], s[1])):
        while at < len(starts) and ends[at] <= a:
            at += 1
        i = at
        while i < len(starts) and starts[i] < b:
            if fixed[i] < 0 and min(b, ends[i]) - max(a, starts[i]) > 0.5 * (ends[i] - starts[i]):
                fixed[i] = k + 1
            i += 1
    chain = [(i, i + 1) for i in range(len(starts) - 1) if starts[i + 1] - ends[i] <= 3]
    groups: dict[str, list[int]] = {}
    for i, key in enumerate(keys):
        if key[0] != "n" or len(key) > LEAST_DIGITS:
            groups.setdefault(key, []).append(i)
    alike: dict[str, list[int]] = {}
    skips = []
    for key, members in groups.items():
        hub = next((i for i in members if fixed[i] > 0), members[0])
        skips += [(hub, i, 1.0) for i in members if i != hub]
        if key[0] == "n" and len(key) > SIMILAR_DIGITS:
            alike.setdefault("s" + key[-SIMILAR_DIGITS:], []).append(hub)
        elif key[0] == "m" and "@" in key:
            alike.setdefault("l" + key[1:].split("@")[0], []).append(hub)
    for key, members in alike.items():
        hub = next((i for i in members if fixed[i] > 0), members[0])
        skips += [(hub, i, SIMILAR_NUMBER if key[0] == "s" else SIMILAR_MAIL) for i in members if i != hub]
    return Field(starts, ends, np.array(rows, float), fixed, chain, skips, alone)


@dataclass
class Potentials:
    """Log potentials: features by label, label pairs of neighbours, agreement of skip edges."""

    node: np.ndarray
    chain: np.ndarray
    skip: float


def marginals(field: Field, pot: Potentials) -> np.ndarray:
    """Label probabilities of the tokens by damped loopy sum-product messages."""
    unary = field.x @ pot.node
    unary = np.clip(unary - unary.max(axis=1, keepdims=True), -MAX_NODE, 0)
    known = field.fixed >= 0
    unary[known] = -30.0
    unary[known, field.fixed[known]] = 0.0
    edges = [(i, j, pot.chain) for i, j in field.chain]
    edges += [(i, j, pot.skip * w * np.eye(N_LABELS)) for i, j, w in field.skips]
    if edges:
        i, j = (np.array([e[k] for e in edges]) for k in (0, 1))
        table = np.stack([e[2] for e in edges])
        table = np.exp(np.concatenate([table, table.transpose(0, 2, 1)]))
        source, target = np.r_[i, j], np.r_[j, i]
        back = np.r_[np.arange(len(i)) + len(i), np.arange(len(i))]
        message = np.zeros((len(source), N_LABELS))
        for _ in range(ROUNDS):
            belief = unary.copy()
            np.add.at(belief, target, message)
            send = belief[source] - message[back]
            send = np.exp(send - send.max(axis=1, keepdims=True))
            new = np.log(np.einsum("ea,eab->eb", send, table))
            new -= new.max(axis=1, keepdims=True)
            new = DAMPING * message + (1 - DAMPING) * new
            settled = np.abs(new - message).max() < SETTLED
            message = new
            if settled:
                break
        np.add.at(unary, target, message)
    p = np.exp(unary - unary.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def added_spans(text: str, spans: list[tuple[int, int, int]], pot: Potentials) -> list[tuple[int, int, int]]:
    """Spans of tokens that the field labels with certainty and that no base span touches."""
    field = build_field(text, spans)
    if field is None or not (field.fixed < 0).any():
        return []
    p = marginals(field, pot)
    out, taken, at = [], sorted((a, b) for a, _, b in spans), 0
    for i in np.flatnonzero((field.fixed < 0) & (p.argmax(axis=1) > 0) & (p.max(axis=1) >= CERTAIN)):
        a, b = field.starts[i], field.ends[i]
        while at < len(taken) and taken[at][1] <= a:
            at += 1
        if at == len(taken) or taken[at][0] >= b:
            out.append((a, int(p[i].argmax()) - 1, b))
    return out


# ---------------------------------------------------------------- fitting


def _softmax_regression(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 300) -> np.ndarray:
    w, target = np.zeros((x.shape[1], N_LABELS)), np.eye(N_LABELS)[y]
    for _ in range(rounds):
        z = x @ w
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        w -= 0.5 * (x.T @ ((p - target) * weight[:, None]) / weight.sum() + 1e-4 * w)
    return w


def statistics(texts: list[str | None]) -> Counter:
    """Counts that the fit needs, under the labels of the base patterns: tokens by features, chain pairs, agreeing skip edges.

    Keys are (what, features as a number or label, label); there are no more of them than feature
    patterns times labels, however many texts are counted.
    """
    seen: Counter = Counter()
    powers = 1 << np.arange(len(FEATURE_NAMES))
    for text in texts:
        field = build_field(text, base_spans(text)) if text else None
        if field is None:
            continue
        labels = np.maximum(field.fixed, 0)
        # What the patterns miss for its surroundings is unlabelled: repeats of what they know, and numbers that stand in one run with others.
        # It is no example of other content, nor a disagreement; two kinds for one content are.
        missed = {x for i, j, _ in field.skips for x, y in ((i, j), (j, i)) if labels[y] and not labels[x]}
        missed.update(i for i, whole in enumerate(field.alone) if not whole and not labels[i])
        looks = zip((field.x @ powers).astype(int).tolist(), labels.tolist(), strict=True)
        seen.update(("node", p, k) for i, (p, k) in enumerate(looks) if i not in missed)
        seen.update(("chain", int(labels[i]), int(labels[j])) for i, j in field.chain if i not in missed and j not in missed)
        seen.update(("skip", int(labels[i] == labels[j]), 0) for i, j, w in field.skips if w == 1.0 and labels[i] and labels[j])
    return seen


def potentials(seen: Counter) -> Potentials:
    """Piecewise fit: nodes by softmax regression, chain and skip edges by log odds of counts."""
    cells = sorted((p, k, n) for (what, p, k), n in seen.items() if what == "node")
    pairs = np.ones((N_LABELS, N_LABELS))
    for (what, a, b), n in seen.items():
        if what == "chain":
            pairs[a, b] += n
    share = pairs / pairs.sum()
    chain = np.log(share / (share.sum(1, keepdims=True) * share.sum(0, keepdims=True)))
    agree, differ = 9.0 + seen["skip", 1, 0], 1.0 + seen["skip", 0, 0]
    odds = np.log((agree + 0.5) / (differ + 0.5)) + np.log(N_LABELS - 1)
    node = np.zeros((len(FEATURE_NAMES), N_LABELS))
    if cells:
        x = (np.array([p for p, _, _ in cells])[:, None] >> np.arange(len(FEATURE_NAMES)) & 1).astype(float)
        node = _softmax_regression(x, np.array([k for _, k, _ in cells]), np.array([n for _, _, n in cells], float))
    return Potentials(node, np.clip(chain, -MAX_CHAIN, MAX_CHAIN), float(np.clip(odds, MIN_SKIP, MAX_SKIP)))


def fit_potentials(texts: list[str | None]) -> Potentials:
    """The potentials of a list of texts."""
    return potentials(statistics(texts))


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    seen: Counter = Counter()
    for batch in batches:
        seen.update(statistics(batch["text"].tolist()))
    if seen:
        yield pd.DataFrame([(*key, n) for key, n in seen.items()], columns=["what", "a", "b", "n"])


def fit(docs: DataFrame) -> Potentials:
    """Potentials from the counts of every text that holds a digit or a sign for at; only sums reach the driver."""
    rows = docs.where(F.col("text").rlike(HAS_TOKEN)).select("text").mapInPandas(_counted, "what string, a long, b long, n long")
    sums = rows.groupBy("what", "a", "b").agg(F.sum("n").alias("n")).collect()
    return potentials(Counter({(r["what"], r["a"], r["b"]): r["n"] for r in sums}))


# ---------------------------------------------------------------- operator


def find(text: Column, pot: Potentials) -> Column:
    """A struct of base and all spans, each an array of (kind, start, end)."""
    span = "array<struct<kind:string,start:int,end:int>>"

    @F.pandas_udf(f"base {span}, spans {span}")
    def spans(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            base_out, all_out = [], []
            for t in texts:
                t = t or ""
                base = base_spans(t)
                more = sorted(base + added_spans(t, base, pot))
                for out, found in ((base_out, base), (all_out, more)):
                    out.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in found])
            yield pd.DataFrame({"base": base_out, "spans": all_out})

    return spans(text)


def find_pii(docs: DataFrame, pot: Potentials | None = None) -> DataFrame:
    """``docs`` plus ``__pii``: base spans and all spans of each text, in code points, ends exclusive.

    Nothing but counts is shuffled. The field runs on every text that has a token, as a token's own
    features can make its label certain without a base span. Defined cases: null and empty texts have
    no spans; repeated rows repeat; spans of different kinds may overlap, added ones never overlap base
    ones; an empty table stays empty; other columns pass through, and where one already has the name
    of the new column, the new one gets underscores behind it.
    """
    common.small_batches(docs.sparkSession)
    name = common.fresh(docs, "__pii")[0]
    return docs.withColumn(name, find(F.col("text"), pot or fit(docs.select("text"))))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's view of :func:`find_pii` over all documents."""
    found = find_pii(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("__pii.base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *map(count, KINDS), F.sha2(text(F.col("__pii.base")), 256).alias("base_sha256"), text(F.col("__pii.spans")).alias("spans")
    )
