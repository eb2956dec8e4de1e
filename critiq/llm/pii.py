"""Personal data: base patterns, and a skip-chain conditional random field over them.

Base: emails, IP addresses, card numbers (Luhn) and phone numbers by the contract's patterns, each
searched in time linear in the text (a long run that never becomes a match is passed over once).

The CRF labels the tokens (runs of non-blanks) that hold a digit or ``@``; all other tokens are clean by
definition.  Node potentials come from token shapes, chain potentials link neighbouring tokens, and skip
potentials link distant tokens that are the same or similar, anywhere in the document: a token to the next with the
same key (its letters and digits, lower-cased; for tokens with many digits the digits alone), and numbers to
numbers.  A number is a token, a base span or a run of neighbouring digit tokens; two are linked if the digits of one
end in the digits of the other (``MIN_SUFFIX`` or more: ``+1 (706) 555-3138``, ``706-555-3138``, ``7065553138``) or, from
``MIN_SIMILAR`` digits on, differ in one digit; their tokens are linked where their digits lie over
each other.  Tokens inside base spans are observed.  Loopy belief propagation (synchronous, damped) runs over all tokens of the
document; a token outside the base spans gets a label if its marginal is at least ``LEAST`` and
skip links tie it to a base span.  So a value that is recognised once is found in all its mentions.

All potentials are learned piecewise from a bounded sample of texts (``SAMPLE`` texts of at most
``SAMPLE_CHARS`` code points with a digit or @): nodes by softmax regression on shapes, both
kinds of links by the log odds that the labels at their ends agree.  Phone numbers of the sample also
train in the other ways of writing them (``rewritten``), which no base pattern finds.

Rows: null text = empty text: no spans.  Repeated rows, null ids: a result row each.  Empty
table: empty result."""
from __future__ import annotations

import re
from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from critiq.llm.common import prepare

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
SAMPLE = 4000
SAMPLE_CHARS = 20_000
LEAST = 0.5
ROUNDS = 20
DAMPING = 0.3
MIN_KEY = 5
MIN_SUFFIX = 7
MIN_SIMILAR = 13
MAX_DIGITS = 19
FULL_NUMBER = 10
STRONGEST = 5.0

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_HINT = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"\S+")
_DIGITS = re.compile(r"[^0-9]+")
_NUMERIC = re.compile(r"[0-9()+.,;:!?-]*[0-9][0-9()+.,;:!?-]*")


def emails(text: str) -> list[tuple[int, int]]:
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        done = at + 1                              # no later local part can reach over this @
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", done)
    return out


def ips(text: str) -> list[tuple[int, int]]:
    out = []
    for chain in _DOTTED.finditer(text):
        parts = chain.group().split(".")
        at = chain.start()
        for k in range(0, len(parts) - 3, 4):      # leftmost matches take the parts by fours
            four = parts[k:k + 4]
            size = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                out.append((at, at + size))
            at += size + 1
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _CARD.finditer(text):
        digits = _DIGITS.sub("", m.group())
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 8 <= len(_DIGITS.sub("", m.group())) <= 15]


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start."""
    if not text or not _HINT.search(text):
        return []
    finders = {"email": emails, "ip": ips, "card": cards, "phone": phones}
    need = {"email": "@" in text, "phone": "+" in text, "ip": "." in text, "card": True}
    return [(k, a, b) for k in KINDS if need[k] for a, b in finders[k](text)]


def shape(token: str) -> list[float]:
    """Features of a token's form (none tells whether a base pattern found it)."""
    digits = _DIGITS.sub("", token)
    n, core = len(digits), token.strip("().,;:!?\"'-")
    letters = sum(c.isalpha() for c in core)
    return [1.0, float("@" in token), float("@" in token and "." in token.rpartition("@")[2]),
            float(token.startswith("+")), float(token.startswith("(")), float("-" in core),
            float(core.count(".") == 3 and not letters), float(core.count(".") == 1 and not letters),
            float(letters > 0), float(n == 0), float(1 <= n <= 2), float(3 <= n <= 4), float(5 <= n <= 7),
            float(8 <= n <= 15), float(16 <= n <= 19), float(n > 19), float(16 <= n <= 19 and luhn(digits))]


def key(token: str) -> str:
    digits = _DIGITS.sub("", token)
    found = digits if len(digits) >= MIN_KEY else "".join(c for c in token.lower() if c.isalnum())
    return found if len(found) >= MIN_KEY else ""


class Graph:
    """The labelled tokens of one text and their links."""

    def __init__(self, text: str):
        spans = base_spans(text)
        self.tokens = [(m.start(), m.end()) for m in _TOKEN.finditer(text)] if _HINT.search(text) else []
        numbered = [(k, s) for k, s in enumerate(self.tokens) if _HINT.search(text, *s)]
        self.tokens = [s for _, s in numbered]
        self.words = [text[a:b] for a, b in self.tokens]
        self.seen = np.full(len(self.tokens), -1)
        starts = [a for a, _ in self.tokens]
        for kind, a, b in reversed(spans):                    # where kinds overlap the first listed holds
            k = max(0, bisect_right(starts, a) - 1)
            while k < len(starts) and starts[k] < b:
                if self.tokens[k][1] > a:
                    self.seen[k] = LABELS.index(kind)
                k += 1
        order = [k for k, _ in numbered]
        self.chain = [(i, i + 1) for i in range(len(order) - 1) if order[i + 1] == order[i] + 1]
        self.equal, last = [], {}
        for i, w in enumerate(self.words):
            if k := key(w):
                if k in last:
                    self.equal.append((last[k], i))
                last[k] = i
        linked = lambda a, b: key(self.words[a]) == key(self.words[b]) != ""
        self.skip = self.equal + sorted(p for p in set(self._alike()) - set(self.chain) if not linked(*p))

    def _numbers(self) -> list[tuple[int, int]]:
        """Numbers as ranges of tokens: base spans, other runs of neighbouring digit tokens, and of such a
        run's tokens those of ``FULL_NUMBER`` digits or more."""
        neighbour = {a for a, _ in self.chain}
        found, start = set(), 0
        plain = [s <= 0 and bool(_NUMERIC.fullmatch(w)) for s, w in zip(self.seen, self.words)]
        for i, w in enumerate(self.words):
            if plain[i] and len(_DIGITS.sub("", w)) >= FULL_NUMBER:
                found.add((i, i + 1))
            ends = i not in neighbour or self.seen[i + 1] != self.seen[i] or plain[i + 1] != plain[i]
            if ends or (plain[i] and w[-1] in ".,;:!?"):
                if plain[i] or self.seen[i] > 0:
                    found.add((start, i + 1))
                start = i + 1
        return sorted(found)

    def _alike(self):
        """Links between the tokens of numbers that end alike or differ in one digit.  Every number is
        compared with the first one under each of its keys, base spans being first, so the work is linear."""
        whole, endings, masked = {}, {}, {}
        for unit in sorted(self._numbers(), key=lambda u: self.seen[u[0]] <= 0):
            if unit[1] - unit[0] > MAX_DIGITS:
                continue
            own = [_DIGITS.sub("", w) for w in self.words[unit[0]:unit[1]]]
            digits = "".join(own)
            if not MIN_SUFFIX <= len(digits) <= MAX_DIGITS or any("@" in w for w in self.words[unit[0]:unit[1]]):
                continue
            at, places = len(digits), []                    # each token's digits, counted from the end
            for i, d in zip(range(*unit), own):
                places.append((i, at - len(d), at))
                at -= len(d)
            ends = [digits[-n:] for n in range(MIN_SUFFIX, len(digits) + 1)]
            masks = ([digits[:k] + "*" + digits[k + 1:] for k in range(len(digits))]
                     if len(digits) >= MIN_SIMILAR else [])
            others = [endings.get(digits)] + [whole.get(e) for e in ends] + [masked.get(m) for m in masks]
            for other in {id(o): o for o in others if o}.values():
                for i, a, b in other:
                    for j, c, d in places:
                        if max(a, c) < min(b, d) and i != j:
                            yield min(i, j), max(i, j)
            for table, keys in ((whole, [digits]), (endings, ends), (masked, masks)):
                for k in keys:
                    table.setdefault(k, places)


class Model:
    def __init__(self, nodes: np.ndarray, chain: np.ndarray, skip: np.ndarray):
        self.nodes, self.chain, self.skip = nodes, chain, skip

    def marginals(self, graph: Graph) -> np.ndarray:
        """Loopy belief propagation in log space; base spans are clamped."""
        n, c = len(graph.words), len(LABELS)
        unary = np.array([shape(w) for w in graph.words]) @ self.nodes
        known = graph.seen > 0
        unary[known] = -1000.0
        unary[known, graph.seen[known]] = 0.0
        pairs = np.array(graph.chain + graph.skip, dtype=np.int64).reshape(-1, 2)
        weight = np.concatenate([np.broadcast_to(self.chain, (len(graph.chain), c, c)),
                                 np.broadcast_to(self.skip, (len(graph.skip), c, c))])
        # Each link carries a message in both directions.
        src, dst = np.r_[pairs[:, 0], pairs[:, 1]], np.r_[pairs[:, 1], pairs[:, 0]]
        weight = np.concatenate([weight, weight.transpose(0, 2, 1)])
        back = np.r_[np.arange(len(pairs)) + len(pairs), np.arange(len(pairs))]
        message = np.zeros((len(src), c))
        belief = unary
        for _ in range(ROUNDS if len(src) else 0):
            out = belief[src] - message[back]
            new = (out[:, :, None] + weight)
            top = new.max(axis=1, keepdims=True)
            new = np.log(np.exp(new - top).sum(axis=1)) + top[:, 0]
            new -= new.max(axis=1, keepdims=True)
            moved = np.abs(new - message).max()
            message = DAMPING * message + (1 - DAMPING) * new
            belief = unary.copy()
            np.add.at(belief, dst, message)
            if moved < 1e-4:
                break
        p = np.exp(belief - belief.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def added(self, text: str) -> list[tuple[str, int, int]]:
        graph = Graph(text)
        if not graph.skip or not (graph.seen > 0).any():
            return []
        tied = np.zeros(len(graph.words), bool)
        tied[graph.seen > 0] = True
        root = list(range(len(graph.words)))

        def find(i):
            while root[i] != i:
                root[i] = i = root[root[i]]
            return i
        for a, b in graph.skip:
            root[find(b)] = find(a)
        group = [find(i) for i in range(len(root))]
        marked = {group[i] for i in np.flatnonzero(tied)}
        p, out = self.marginals(graph), []
        best = p.argmax(axis=1)
        for i in range(len(graph.words)):
            if graph.seen[i] > 0 or not best[i] or p[i, best[i]] < LEAST or group[i] not in marked:
                continue
            a, b = graph.tokens[i]
            word = text[a:b]
            pair = "(" in word and ")" in word               # an area code's brackets belong to it
            a += len(word) - len(word.lstrip("\"'<[" if pair else "(\"'<["))
            b -= len(word) - len(word.rstrip(".,;:!?\"'>]" if pair else ".,;:!?)\"'>]"))
            if a >= b:
                continue
            kind = LABELS[best[i]]
            if out and out[-1][0] == kind and out[-1][3] == i - 1 and (i - 1, i) in graph.chain and graph.words[i - 1][-1] not in ".,;:!?":
                out[-1] = (kind, out[-1][1], b, i)
            else:
                out.append((kind, a, b, i))
        return [x[:3] for x in out]

    def spans(self, text: str | None) -> tuple[list, list]:
        """Base spans, and all spans by kind and start."""
        base = base_spans(text)
        if not base:
            return base, base
        return base, sorted(base + self.added(text), key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def _agreement(pairs: list[tuple[int, int]]) -> np.ndarray:
    """A link's potential: the log odds that the labels at its ends agree, at most ``STRONGEST``,
    for every pair of equal labels."""
    same = sum(a == b for a, b in pairs)
    odds = np.log((same + 1.0) / (len(pairs) - same + 0.5))
    return np.eye(len(LABELS)) * np.clip(odds, 0.0, STRONGEST)


def rewritten(text: str) -> list[str]:
    """The phone numbers of a text as they are written without their country's code or blanks."""
    out = []
    for a, b in phones(text) if "+" in text else []:
        digits = _DIGITS.sub("", text[a:b])
        short = digits[-10:]
        out += [digits, short, f"{short[:-7]}-{short[-7:-4]}-{short[-4:]}".lstrip("-")]
    return out


def fit(texts: list[str], steps: int = 300) -> Model:
    graphs = [Graph(t) for t in texts]
    others = [w for t in texts for w in rewritten(t)]
    words = [shape(w) for g in graphs for w in g.words]
    y = np.concatenate([np.maximum(g.seen, 0) for g in graphs]) if words else np.empty(0, int)
    words += [shape(w) for w in others]
    y = np.concatenate([y, np.full(len(others), LABELS.index("phone"))]).astype(int)
    w = np.zeros((len(shape("")), len(LABELS)))
    w[0, 0] = 2.0
    if words:
        x, target = np.array(words), np.eye(len(LABELS))[y]
        m, v = np.zeros_like(w), np.zeros_like(w)
        for t in range(1, steps + 1):
            z = x @ w
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            g = x.T @ (p - target) / len(x) + 3e-3 * w
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    label = lambda g, i: max(int(g.seen[i]), 0)
    chain = _agreement([(label(g, a), label(g, b)) for g in graphs for a, b in g.chain])
    skip = _agreement([(label(g, a), label(g, b)) for g in graphs for a, b in g.equal])
    return Model(w, chain, skip)


def train(docs: DataFrame) -> Model:
    known = docs.select("text").filter(F.col("text").rlike("[0-9@]") & (F.length("text") <= SAMPLE_CHARS))
    n = known.count()
    draw = F.pmod(F.xxhash64("text", F.lit("pii")), F.lit(1 << 30)) / float(1 << 30)
    texts = [r["text"] for r in known.filter(draw < F.lit(SAMPLE / max(n, 1))).limit(2 * SAMPLE).collect()]
    return fit(sorted(texts))


def personal_data(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with base and all_spans array<struct<kind,start,end>> (columns of these names are replaced)."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)
    form = "array<struct<kind:string,start:int,end:int>>"

    @F.pandas_udf(f"base {form}, all_spans {form}")
    def run(text: pd.Series) -> pd.DataFrame:
        got = [shared.value.spans(t) for t in text]
        as_rows = lambda spans: [{"kind": k, "start": a, "end": b} for k, a, b in spans]
        return pd.DataFrame({"base": [as_rows(b) for b, _ in got], "all_spans": [as_rows(s) for _, s in got]})

    return (docs.withColumn("__pii", run(F.col("text"))).withColumn("base", F.col("__pii.base"))
            .withColumn("all_spans", F.col("__pii.all_spans")).drop("__pii"))


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    found = personal_data(docs.select("doc_id", "text"), train(docs))
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in KINDS],
                        F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("all_spans").alias("spans"))
