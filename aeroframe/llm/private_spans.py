"""Personal data in texts: fixed patterns, and a skip-chain conditional random field that adds what they miss.

Words with a digit or an @ are the field's variables; any other word has no personal data by definition. Neighbouring words
share a chain potential. A variable and the one before it in the document with the same or a similar key (equal letters and
digits, or equal last digits) share a skip potential, so a value that is recognised once is recognised where it stands again
in another form. Labels come from loopy sum-product messages over both kinds of edges; words inside pattern matches are
fixed to their kind. Weights are fitted by pseudo-likelihood on a bounded sample, with the pattern matches as labels.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aeroframe.llm.text import seeded_sample, small_batches

KINDS = ("email", "ip", "card", "phone")
#: Labels of the field: 0 is none, then the kinds in order.
N_LABELS = len(KINDS) + 1
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]*\Z")
QUADS = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
VARIABLE = re.compile(r"[^\x20\x09-\x0D]*[0-9@][^\x20\x09-\x0D]*")
EDGES = ".,;:!?\"'()[]{}<>"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """As a leftmost search would find them, in one walk over the @ signs."""
    done = 0
    at = text.find("@")
    while at >= 0:
        m = DOMAIN.match(text, at + 1)
        if m:
            start = at
            while start > done and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                done = m.end()
                yield start, done
        at = text.find("@", max(at + 1, done))


def addresses(text: str) -> Iterator[tuple[int, int]]:
    for m in QUADS.finditer(text):
        at, parts = m.start(), m[0].split(".")
        for k in range(0, len(parts) - 3, 4):
            own = parts[k:k + 4]
            end = at + sum(map(len, own)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in own):
                yield at, end
            at = end + 1


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in PHONE.finditer(text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            yield m.span()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all pattern matches, by start, then kind."""
    return sorted((s, k, e) for k, find in enumerate((emails, addresses, cards, phones)) for s, e in find(text))


N_FEATURES = 20


def describe(word: str) -> list[float]:
    """What the field sees of one word."""
    digits = "".join(c for c in word if "0" <= c <= "9")
    n, letters = len(digits), sum(c.isalpha() for c in word)
    core = word.strip(EDGES)
    parts = core.split(".")
    quad = len(parts) == 4 and all(p.isascii() and p.isdigit() for p in parts)
    return [1.0, float("@" in word), float(bool(re.fullmatch(r"[^@]+@[^@]+\.[^@]+", core))), float(n <= 2), float(3 <= n <= 4), float(5 <= n <= 9), float(10 <= n <= 13), float(14 <= n <= 19), float(n > 19),
            float(quad), float(quad and all(len(p) <= 3 and int(p) <= 255 for p in parts)), float(core[:1] == "+" or word[:1] == "+"), float("(" in word or ")" in word), float("-" in core), float("." in core),
            float(letters > 0), float(letters > 0 and n > 0 and len(core) >= 20), float(14 <= n <= 19 and luhn(digits)), float(n > 0 and core.isascii() and core.isdigit()), float(len(core) <= 2)]


@dataclass
class Graph:
    """The variables of one text: places, features, fixed labels (-1: free), chain edges and skip edges."""
    spans: list
    x: np.ndarray
    fixed: np.ndarray
    chain: np.ndarray       # index of the right neighbour, -1 if that is no variable
    skips: np.ndarray       # pairs (earlier, later)


def graph(text: str, base: list[tuple[int, int, int]]) -> Graph:
    spans = [m.span() for m in VARIABLE.finditer(text)]
    x = np.array([describe(text[s:e]) for s, e in spans], np.float64).reshape(len(spans), N_FEATURES)
    fixed = np.full(len(spans), -1)
    k = 0
    marks = sorted((s, e, kind) for s, kind, e in base)
    ends = {e: "".join(c for c in text[s:e] if "0" <= c <= "9") for s, e, _ in marks}
    for i, (s, e) in enumerate(spans):
        while k < len(marks) and marks[k][1] <= s:
            k += 1
        j = k
        while j < len(marks) and marks[j][0] < e:
            if marks[j][1] > s and fixed[i] < 0:
                fixed[i] = marks[j][2] + 1
            j += 1
    chain = np.array([i + 1 if i + 1 < len(spans) and text[spans[i][1]:spans[i + 1][0]].isspace() else -1 for i in range(len(spans))], np.int64)
    last: dict[tuple, int] = {}
    skips = []
    for i, (s, e) in enumerate(spans):
        word = text[s:e]
        digits = "".join(c for c in word if "0" <= c <= "9")
        keys = []
        if "@" in word:
            keys.append(("word", "".join(c for c in word.lower() if c.isalnum() or c == "@")))
        else:       # the last word of a match stands for all of it
            whole = next((ends[e - t] for t in range(3) if e - t in ends), digits)
            keys += [("digits", d) for d in {digits, whole} if len(d) >= 6]
            keys += [("tail", whole[-7:])] if len(whole) > 6 else []
        for key in keys:
            if last.get(key, i) != i and (not skips or skips[-1] != (last[key], i)):
                skips.append((last[key], i))
            last[key] = i
    return Graph(spans, x, fixed, chain, np.array(skips, np.int64).reshape(-1, 2))


@dataclass
class Field:
    """Log potentials: words (features x labels), chain (left x right), skip (bonus of each shared label)."""
    node: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


def repeated_forms(text: str, base: list[tuple[int, int, int]], draw: np.random.Generator) -> tuple[str, list[tuple[int, int, int]]]:
    """A training text: the text, then its phone and card numbers in other forms, labelled, each beside a random number of that form, not labelled."""
    out, marks = [text], list(base)
    at = len(text)
    for s, k, e in base:
        digits = "".join(c for c in text[s:e] if "0" <= c <= "9")
        if k == KINDS.index("phone"):
            forms = [lambda d: f"{d[-10:-7]}-{d[-7:-4]}-{d[-4:]}", lambda d: f"{d[-10:-7]}.{d[-7:-4]}.{d[-4:]}", lambda d: d[-10:], lambda d: f"({d[-10:-7]}){d[-7:-4]}-{d[-4:]}", lambda d: f"{d[-7:-4]}-{d[-4:]}"]
        elif k == KINDS.index("card"):
            forms = [lambda d: ".".join(d[i:i + 4] for i in range(0, len(d), 4)), lambda d: "/".join(d[i:i + 4] for i in range(0, len(d), 4)), lambda d: f"#{d}"]
        else:
            continue
        form = forms[draw.integers(len(forms))]
        other = "".join(str(x) for x in draw.integers(0, 10, len(digits)))
        for value, kind in ((digits, k), (other, None)):
            own = form(value)
            out.append(f" and {own}")
            if kind is not None:
                marks.append((at + 5, kind, at + 5 + len(own)))
            at += 5 + len(own)
    return "".join(out), sorted(marks)


def fit(texts: list[str], steps: int = 250, rate: float = 0.1, decay: float = 1e-3) -> Field:
    """Pseudo-likelihood by gradient steps: each word's label given its neighbours', the pattern matches and their other forms as labels.

    Without any variable the field has no weights and labels nothing."""
    draw = np.random.default_rng(5)
    graphs = [g for g in (graph(*repeated_forms(t, base_spans(t), draw)) for t in texts) if len(g.spans)]
    field = Field(np.zeros((N_FEATURES, N_LABELS)), np.zeros((N_LABELS, N_LABELS)), np.zeros(N_LABELS))
    if not graphs:
        return field
    shift = np.concatenate([[0], np.cumsum([len(g.spans) for g in graphs])])
    x = np.concatenate([g.x for g in graphs])
    y = np.maximum(np.concatenate([g.fixed for g in graphs]), 0)
    right = np.concatenate([np.where(g.chain >= 0, g.chain + s, -1) for g, s in zip(graphs, shift, strict=False)])
    left = np.full(len(y), -1)
    left[right[right >= 0]] = np.flatnonzero(right >= 0)
    skips = np.concatenate([g.skips + s for g, s in zip(graphs, shift, strict=False)])
    one = np.eye(N_LABELS)
    before, after = one[np.where(left >= 0, y[left], 0)], one[np.where(right >= 0, y[right], 0)]
    near = np.zeros((len(y), N_LABELS))
    np.add.at(near, skips[:, 0], one[y[skips[:, 1]]])
    np.add.at(near, skips[:, 1], one[y[skips[:, 0]]])
    names, moments = ("node", "chain", "skip"), {}
    for step in range(1, steps + 1):
        score = x @ field.node + before @ field.chain + after @ field.chain.T + near * field.skip
        score -= score.max(axis=1, keepdims=True)
        p = np.exp(score)
        p /= p.sum(axis=1, keepdims=True)
        miss = (one[y] - p) / len(y)
        grads = (x.T @ miss, before.T @ miss + miss.T @ after, (near * miss).sum(axis=0))
        for name, g in zip(names, grads, strict=True):
            w = getattr(field, name)
            g = g - decay * w / 10
            m, v = moments.get(name, (np.zeros_like(w), np.zeros_like(w)))
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            moments[name] = m, v
            setattr(field, name, w + rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8))
    field.skip = np.maximum(field.skip, 0.0)
    return field


def label(g: Graph, field: Field, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Most likely label of every variable by loopy messages, and its probability. Every message is updated at once; damped by half."""
    n = len(g.spans)
    local = g.x @ field.node
    local[g.chain < 0] += field.chain[:, 0]
    has_left = np.zeros(n, bool)
    has_left[g.chain[g.chain >= 0]] = True
    local[~has_left] += field.chain[0]
    held = np.flatnonzero(g.fixed >= 0)
    local[held] = -1e3
    local[held, g.fixed[held]] = 0.0
    links = np.flatnonzero(g.chain >= 0)
    skip = np.diag(field.skip)
    # directed edges: from, to, potential (from label x to label)
    ends = [(links, g.chain[links], field.chain), (g.chain[links], links, field.chain.T), (g.skips[:, 0], g.skips[:, 1], skip), (g.skips[:, 1], g.skips[:, 0], skip)]
    source, target = np.concatenate([e[0] for e in ends]).astype(np.int64), np.concatenate([e[1] for e in ends]).astype(np.int64)
    if len(source):
        sizes = [len(e[0]) for e in ends]
        a, b = sizes[0], sizes[0] + sizes[1]
        back = np.concatenate([np.arange(a, b), np.arange(0, a), np.arange(b + sizes[2], len(source)), np.arange(b, b + sizes[2])])
        message = np.zeros((len(source), N_LABELS))
        for _ in range(rounds):
            belief = local.copy()
            np.add.at(belief, target, message)
            out = belief[source] - message[back]
            new = np.empty_like(message)
            at = 0
            for (s, _, potential) in ends:
                part = out[at:at + len(s), :, None] + potential[None]
                top = part.max(axis=1, keepdims=True)
                new[at:at + len(s)] = (top + np.log(np.exp(part - top).sum(axis=1, keepdims=True)))[:, 0]
                at += len(s)
            new -= new.max(axis=1, keepdims=True)
            if np.abs(new - message).max() < 1e-4:
                message = new
                break
            message = 0.5 * message + 0.5 * new
        local = local.copy()
        np.add.at(local, target, message)
    p = np.exp(local - local.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    return p.argmax(axis=1), p.max(axis=1)


def plausible(kind: int, own: str) -> bool:
    """Whether a value of this kind can look like that at all."""
    digits = "".join(c for c in own if "0" <= c <= "9")
    if KINDS[kind] == "email":
        return re.search(r"@.*\.", own) is not None
    if KINDS[kind] == "ip":
        parts = re.split(r"[^0-9]+", own.strip(EDGES))
        return len(parts) == 4 and all(p and len(p) <= 3 and int(p) <= 255 for p in parts)
    return 14 <= len(digits) <= 19 and luhn(digits) if KINDS[kind] == "card" else 7 <= len(digits) <= 15


def added_spans(text: str, base: list[tuple[int, int, int]], field: Field, sure: float = 0.5) -> list[tuple[int, int, int]]:
    """Runs of variables that the field gives one kind with probability ``sure``, outside all pattern matches, if the kind can look like that.

    A word that can be a card number by itself ends a run."""
    g = graph(text, base)
    if not len(g.spans):
        return []
    labels, p = label(g, field)
    labels = np.where((g.fixed < 0) & (p >= sure), labels, 0)
    out, i = [], 0
    while i < len(labels):
        k = labels[i]
        j = i
        while k and g.chain[j] >= 0 and labels[j + 1] == k and not (KINDS[k - 1] == "card" and any(sum(c.isdigit() for c in text[a:z]) >= 14 for a, z in g.spans[j:j + 2])):
            j += 1
        if k:
            s, e = g.spans[i][0], g.spans[j][1]
            own = text[s:e]
            s, e = s + len(own) - len(own.lstrip(EDGES.replace("(", ""))), e - len(own) + len(own.rstrip(EDGES))
            if s < e and plausible(int(k) - 1, text[s:e]):
                out.append((s, int(k) - 1, e))
        i = j + 1
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def _find(field):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = field.value
        none = hashlib.sha256(b"").hexdigest()
        digit = re.compile("[0-9@]")
        for b in batches:
            counts, digests, spans = np.zeros((b.num_rows, len(KINDS)), np.int64), [], []
            for i, text in enumerate(b.column("body").to_pylist()):
                if not text or not digit.search(text):
                    digests.append(none)
                    spans.append("")
                    continue
                base = base_spans(text)
                for _, k, _ in base:
                    counts[i, k] += 1
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(base + added_spans(text, base, weights)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(counts[:, k]) for k in range(len(KINDS))], pa.array(digests, pa.string()), pa.array(spans, pa.string())],
                                             ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])
    return run


def find_private(docs: DataFrame, key: str = "doc_id", text: str = "text", sample_rows: int = 800, seed: int = 3) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone (pattern matches), base_sha256 and spans (kind:start:end).

    The field is fitted on the ``sample_rows`` texts with a digit or an @ that come first by a seeded hash; every text is searched
    whole. Null, empty and blank texts have no spans; equal texts get equal spans; null and repeated keys pass through; extra
    columns are ignored; an empty table gives no rows. Texts are independent: nothing but the sample is moved."""
    small_batches(docs.sparkSession, 500)
    named = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("body"))
    sample = seeded_sample(named.filter(F.col("body").rlike("[0-9@]")).select("body", F.xxhash64(F.lit(seed), "doc_id", "body").alias("o")), "o", sample_rows, "body").collect()
    field = docs.sparkSession.sparkContext.broadcast(fit([r["body"] for r in sample]))
    kind = docs.schema[key].dataType.simpleString()
    return named.mapInArrow(_find(field), f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
