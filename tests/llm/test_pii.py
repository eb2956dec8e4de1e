import hashlib
import itertools
import random
import re

import numpy as np

from critiq.llm import pii


def plain(text):
    """The contract's patterns by the re module."""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
            if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        check = sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(digits)))
        if 16 <= len(digits) <= 19 and check % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)
            if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return out


def test_base_equals_patterns():
    rng = random.Random(4)
    for alphabet in ("0123456789.@+- ()ab_%", "01.", "a@.-", "+1 ()", "0123456789 -", "é٣@.a1 ", "4 1-\n\t+"):
        for _ in range(4000):
            s = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
            assert pii.base_spans(s) == plain(s), s
    s = "card 4111 1111 1111 1111, 4111111111111112; a.b+c@x-y.example.com. 1.2.3.4.5.6.7.8 999.1.1.1 +1 (705) 555-5569"
    assert pii.base_spans(s) == plain(s) and {k for k, _, _ in plain(s)} == set(pii.KINDS)


def test_long_runs():
    n = 300_000
    assert pii.base_spans("a" * n) == pii.base_spans("@" * n) == pii.base_spans("+1" + " " * n) == []
    assert pii.base_spans("1." * (n // 2)) == [("ip", 8 * k, 8 * k + 7) for k in range(n // 8)]
    assert pii.base_spans("1" * n) == pii.base_spans("1 " * n) == pii.base_spans("a@" * n) == []


def sample():
    rng = random.Random(9)
    out = []
    for k in range(300):
        phone = f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"
        mail, word = f"user.{k}@mail{k % 7}.example.com", rng.choice(["and", "or"])
        out.append(f"Write to {mail} {word} call {phone} today. Again {phone} and {mail}. Room {rng.randint(1, 400)} code "
                   f"{rng.randint(10**9, 10**10)} of {rng.randint(1900, 2030)}")
    return out


def test_labels_travel_along_skip_links():
    model = pii.fit(sample())
    text = "Call +1 (705) 555-5569 now. The number 555-5569 is right; code 8675309 is not."
    base, spans = model.spans(text)
    assert base == plain(text)
    assert [text[a:b] for _, a, b in spans] == ["+1 (705) 555-5569", "555-5569"]
    upper = "a.user@mail.example.com wrote, A.User@mail.example.com. read, 4242424 no"
    assert [upper[a:b] for _, a, b in model.spans(upper)[1]] == ["a.user@mail.example.com", "A.User@mail.example.com"]
    clean = "In 1999 and 1999 and 2001 there were 12345678 and 12345678 of them"
    assert model.spans(clean) == ([], [])
    for t in sample()[:50]:
        base, spans = model.spans(t)
        assert set(base) <= set(spans)


def test_similar_numbers_are_linked():
    model = pii.fit(sample())
    text = ("Call +1 (706) 555-3138 now. Later 706-555-3138 or 7065553138 or 706 555 3138, (706) 555-3138, not 415-555-3138 nor 8005550000. "
            "Order 20240011 of 2019.")
    base, spans = model.spans(text)
    assert base == plain(text)
    assert [text[a:b] for _, a, b in spans] == ["+1 (706) 555-3138", "706-555-3138", "7065553138", "706 555 3138", "(706) 555-3138"]
    assert {k for k, _, _ in spans} == {"phone"}
    links = lambda t: {(g.words[a], g.words[b]) for g in [pii.Graph(t)] for a, b in g.skip}
    assert links("4111111111111111 is not 4111111111111112") == {("4111111111111111", "4111111111111112")}
    assert links("4111111111111111 is not 4111111111111122") == set()
    assert ("4111", "41111111") in links("4111 1111 1111 1111 and 41111111 1111 1112")
    assert links("5551234 and 9995551234 and 8885551234") == {("5551234", "9995551234"), ("5551234", "8885551234")}
    assert links("7065553138 or +17065553138") == {("7065553138", "+17065553138")}


def exact(model, graph):
    """Marginals by enumeration of all labellings."""
    n, c = len(graph.words), len(pii.LABELS)
    node = np.array([pii.shape(w) for w in graph.words]) @ model.nodes
    total = np.zeros((n, c))
    for y in itertools.product(range(c), repeat=n):
        if any(s > 0 and s != v for s, v in zip(graph.seen, y)):
            continue
        z = sum(node[i, v] for i, v in enumerate(y) if graph.seen[i] <= 0)
        z += sum(model.chain[y[a], y[b]] for a, b in graph.chain) + sum(model.skip[y[a], y[b]] for a, b in graph.skip)
        total[range(n), y] += np.exp(z)
    return total / total.sum(axis=1, keepdims=True)


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(3)
    trees = ["5551234 x 5551234 y 5551234", "12 34 56", "a@b.example.com of 5551234 z a@b.example.com 77"]
    loops = ["5551234 8887654 x 5551234 8887654", "+17065553138 now 7065553138 z 555-3138 y 7065553138"]
    for k, text in enumerate(trees + loops):
        size = len(pii.LABELS)
        sym = lambda: (lambda m: (m + m.T) / 2)(rng.normal(0, 0.7, (size, size)))
        model = pii.Model(rng.normal(0, 0.5, (len(pii.shape("")), size)), sym(), sym())
        graph = pii.Graph(text)
        got, want = model.marginals(graph), exact(model, graph)
        if k < len(trees):
            assert np.abs(got - want).max() < 2e-3
        else:
            assert len(graph.chain) + len(graph.skip) >= len(graph.words)         # a loop
            assert np.abs(got - want).max() < 0.12


def test_query_columns(spark, messy, nothing):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for df in (docs, messy):
        texts = {}
        for r in df.collect():
            texts.setdefault(r.doc_id, []).append(plain(r.text or ""))
        rows = pii.digest(df).collect()
        assert len(rows) == df.count()
        for r in rows:
            by_hash = {hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in s).encode()).hexdigest(): s for s in texts[r.doc_id]}
            base = by_hash[r.base_sha256]
            assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(x[0] == k for x in base) for k in pii.KINDS)
            spans = [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in r.spans.split(",") if x)]
            assert set(base) <= set(spans)
            assert spans == sorted(spans, key=lambda s: (pii.KINDS.index(s[0]), s[1]))
    assert pii.digest(nothing).count() == 0


def test_other_columns_stay(messy):
    model = pii.fit(sample())
    out = pii.personal_data(messy, model)
    assert set(messy.columns) | {"base", "all_spans"} == set(out.columns) and out.count() == messy.count()
