import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spanloom.llm import pii
from tests.llm.helpers import awkward, same_values

ALPHABET = ["a", "1", ".", "@", "-", "+", " ", "%", "_", "(", ")", "x@y.z", "a@b", "127.0.0.1", "4111 1111 1111 1111", "+1 555 010 9999", "é"]


def brute(text):
    """The contract's patterns, each scanned from the left, failing matches dropped."""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 12 <= len(d) <= 19 and sum(sum(divmod(x * (1 + k % 2), 10)) for k, x in enumerate(d[::-1])) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(ALPHABET), max_size=30).map("".join))
def test_base_patterns(text):
    assert pii.base_spans(text) == brute(text)


@pytest.fixture(scope="module")
def potentials():
    rng = random.Random(1)
    texts = []
    for _ in range(400):
        d = "".join(rng.choice("0123456789") for _ in range(10))
        texts.append(f"call +1 {d[:3]} {d[3:6]} {d[6:]} or mail u{d[:3]}@site{d[3]}.com room {d[:2]} year 20{d[:2]} id {d}{d[:3]} host 10.{int(d[:2])}.0.{d[0]}")
    return pii.fit_potentials(texts)


@pytest.mark.parametrize(
    ("text", "added"),
    [
        ("Call +1 (555) 010-9999 now. Later 1-555-010-9999, or 555 010 9999 in room 12.", ["1-555-010-9999", "555 010 9999"]),
        ("mail a.b@x.com; again a.b (at) x.com", ["a.b (at) x.com"]),
        ("4111 1111 1111 1111 then 4111.1111.1111.1111", ["4111.1111.1111.1111"]),
        ("the year 2024 and 1234567812345678 and 1234567812345678", []),
        ("no digits here", []),
    ],
)
def test_labels_travel_along_skip_edges(potentials, text, added):
    base = pii.base_spans(text)
    assert [text[a:b] for a, _, b in pii.added_spans(text, base, potentials)] == added


@pytest.mark.parametrize("text", ["a" * 200_000 + " a@b.c", "1" * 100_000, "@" * 50_000, "1." * 50_000, "a@ " * 50_000, "a(at)" * 50_000, "1 " * 100_000, "(" * 100_000, "1234567 " * 30_000, "a@b.c " + "1 " * 50_000])
def test_long_runs_take_linear_time(potentials, text):
    pii.added_spans(text, pii.base_spans(text), potentials)


def test_messages_agree_with_enumeration(potentials):
    """On a chain the messages are exact."""
    import itertools

    import numpy as np

    text = "12 34 +1 555 010 9999"
    field = pii.build_field("7 (8) 9", [])
    field.fixed[:] = -1
    assert text and len(field.starts) >= 1
    n = len(field.starts)
    unary = np.clip((u := field.x @ potentials.node) - u.max(axis=1, keepdims=True), -pii.MAX_NODE, 0)
    want = np.zeros((n, pii.N_LABELS))
    for labels in itertools.product(range(pii.N_LABELS), repeat=n):
        w = np.exp(sum(unary[i, x] for i, x in enumerate(labels)) + sum(potentials.chain[labels[i], labels[j]] for i, j in field.chain))
        for i, x in enumerate(labels):
            want[i, x] += w
    assert np.allclose(pii.marginals(field, potentials), want / want.sum(axis=1, keepdims=True), atol=1e-3)


def test_query_against_brute_force(spark, sf):
    rows = {r["doc_id"]: r for r in pii.op3_pii(spark, sf).collect()}
    for d, text in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        want = brute(text)
        assert [rows[d][f"n_{k}"] for k in pii.KINDS] == [sum(s[1] == i for s in want) for i in range(4)]
        assert rows[d]["base_sha256"] == hashlib.sha256(pii.joined(want).encode()).hexdigest()
        assert set(pii.joined(want).split(",")) <= set(rows[d]["spans"].split(",")) | {""}


def planted(n, seed=5):
    """(text, spans that the patterns miss): personal data, once as the patterns know it and again written differently, among decoys."""
    rng = random.Random(seed)
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    filler = ["in room", "on page", "the year 2024 and", "version 2.0 of", "price 19.99 or", "about", "then", "see 12/05/2023 or", "costs 1,250 to"]

    def card(valid=True):
        while True:
            d = rng.choice("45") + digits(15)
            if pii.luhn(d) == valid:
                return d

    for _ in range(n):
        pieces, missed = [], []
        for kind in rng.sample(["phone", "card", "email", "glued", "decoy"], rng.randint(1, 4)):
            if kind == "phone":
                a, b, c = digits(3), digits(3), digits(4)
                pieces += [f"+1 ({a}) {b}-{c}", x := rng.choice([f"{a}-{b}-{c}", f"1.{a}.{b}.{c}", f"{a} {b} {c}", f"+1/{a}/{b}/{c}"])]
                missed.append(x)
            elif kind == "card":
                d = card()
                pieces += [rng.choice(["", " ", "-"]).join(d[i : i + 4] for i in range(0, 16, 4)), x := ".".join(d[i : i + 4] for i in range(0, 16, 4))]
                missed.append(x)
            elif kind == "email":
                name, host = f"u{digits(3)}.x", f"mail{digits(1)}.example.com"
                pieces += [f"{name}@{host}", x := rng.choice([f"{name} (at) {host}", f"{name}[at]{host}", f"{name} (at) {host.replace('.', ' (dot) ')}"])]
                missed.append(x)
            elif kind == "glued":
                d, e = card(), card()
                pieces.append(f"{d} {e}")
                missed += [d, e]
            else:
                pieces += [card(valid=False), digits(5), x := card(valid=False), x, f"{digits(2)}.{digits(1)}", digits(8)]
        yield " ; ".join(f"{rng.choice(filler)} {p} word" for p in pieces), missed


def test_field_finds_what_patterns_miss(spark):
    rows = list(planted(400))
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    right = found = wanted = 0
    for r in pii.find_pii(df).collect():
        text, missed = rows[r["doc_id"]]
        base = {(s["kind"], s["start"], s["end"]) for s in r["__pii"]["base"]}
        added = [text[s["start"] : s["end"]] for s in r["__pii"]["spans"] if (s["kind"], s["start"], s["end"]) not in base]
        left = list(missed)
        for x in added:
            if x in left:
                left.remove(x)
                right += 1
        found, wanted = found + len(added), wanted + len(missed)
    assert wanted > 500 and right >= 0.9 * wanted and right >= 0.9 * found


def test_field_adds_single_numbers_on_the_tables(spark):
    """In the tables the patterns drop numbers that stand side by side; the field finds them one by one."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    added = 0
    for r in pii.find_pii(docs).where("size(__pii.spans) > size(__pii.base)").collect():
        base = set(map(tuple, r["__pii"]["base"]))
        for kind, a, b in set(map(tuple, r["__pii"]["spans"])) - base:
            d = [c for c in r["text"][a:b] if c.isdigit()]
            assert kind != "card" or (len(d) <= 16 and pii.luhn("".join(d)))
            assert kind != "phone" or len(d) <= 15
            added += 1
    assert added > 0


def test_counts_over_partitions_give_the_fit_of_all_texts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("text")
    one, many = pii.fit_potentials([r[0] for r in docs.collect()]), pii.fit(docs.repartition(5))
    assert np.allclose(one.node, many.node) and np.allclose(one.chain, many.chain) and one.skip == many.skip


def test_a_label_reaches_every_repeat(potentials):
    """However many repeats stand between, a mention is two steps from the one that the patterns know."""
    text = " x ".join(["555.010.9999"] * 60) + " x +1 (555) 010-9999"
    assert len(pii.added_spans(text, pii.base_spans(text), potentials)) == 60


def test_awkward_rows(spark):
    df = awkward(spark)
    out = pii.find_pii(df)
    assert out.columns == [*df.columns, "__pii_"] and same_values(df, out)
    assert pii.find_pii(df.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["+1/555/123/4567", "no mail or number else, only +1/555/123/4567"])
def test_field_runs_without_base_spans_and_edges(text, spark):
    node = np.zeros((len(pii.FEATURE_NAMES), pii.N_LABELS))
    node[pii.FEATURE_NAMES.index("plus"), pii.KINDS.index("phone") + 1] = 4.0
    pot = pii.Potentials(node, np.zeros((pii.N_LABELS, pii.N_LABELS)), 5.0)
    a = text.index("+")
    assert pii.base_spans(text) == [] and pii.added_spans(text, [], pot) == [(a, 3, len(text))]
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert [tuple(s) for s in pii.find_pii(df, pot).first()["__pii"]["spans"]] == [("phone", a, len(text))]


@pytest.mark.parametrize(("text", "n"), [("10.0.0.1 host 10.0.0.1", 1), ("a@b.c or a@b.c", 1), ("10001 host 10.0.0.1", 0), ("12345 and 12345", 0), ("123456 and 123456", 1)])
def test_short_addresses_have_skip_edges(text, n):
    assert sum(w == 1.0 for _, _, w in pii.build_field(text, []).skips) == n
