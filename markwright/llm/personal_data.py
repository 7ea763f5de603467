"""Personal data: base patterns, and a skip-chain conditional random field that adds spans.

Base spans come from four patterns with checks (see ``base_spans``).  The field then labels what the document
says again in other forms: a phone number without its country code, a card number with other separators, an address
without its end.

* Nodes: every base span, whose label is observed, and every other token that holds a digit or an at sign or is the
  local part of a base address (``john.doe``); their labels are O, email, ip, card or phone.  Other tokens are O for sure.
* Unary potentials: shape of the token, numbers of digits, dots and at signs, checks (Luhn, parts at most 255), and the
  characters around it.
* Chain edges join neighbours that are to be labelled and have only separators between them; a base span ends where its pattern ends.
* Skip edges join all mentions of one form, however distant: the same digits, the same last seven digits, the same address, the
  same local part.  Each form is a node of its own (an entity), and a mention has an edge to it, so
  m mentions make m edges, two hops apart.  An entity whose base spans agree in their kind is observed to be of it.  The digits of neighbouring tokens are also joined, so that a number in several tokens has the form of its whole.

The pairwise potentials are shared by all labels: one weight for two O's, one for the same kind, for chain and for skip edges each.
Inference is loopy belief propagation until no message moves by more than ``STILL`` (damping grows, so it always ends);
a node whose best label is not O, and that is not O with at least ``SURE``, becomes a span, joined with such neighbours of its label.

Training is by pseudo-likelihood.  Documents seldom say what is O for sure next to a base span, so mentions are held
out: into each training document that has base spans, repeats of some of them are planted in other forms, as tokens that are
not observed but have the label of their source.  Tokens that share a form with a base span by themselves are left out, as nobody
has labelled them; all other tokens are O.  A share of the unary features is hidden in training, so that the field does not rely on the shapes
of the forms that were planted but on what mentions share.

Bounds on training, and on nothing else: about ``MAX_ROWS`` documents, and of their tokens about ``MAX_NODES`` labelled and as many O ones, all by hash.

Defined results: a null text is empty and has no spans; repeated rows get the same result; with no labelled
tokens in the sample only base spans are found; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import pickle
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markwright.llm.sampling import bounded_batches, hash_sample
from markwright.session import materialize

KINDS = ("email", "ip", "card", "phone")
MAX_ROWS = 20_000
MAX_NODES = 40_000
STILL = 1e-4
SURE = 0.6
PLANTINGS = 3  # times that a training document is read, each with other repeats
SUFFIX = 7  # digits that tell a number
SLOTS = 1024
NOTHING = SLOTS - 1  # a slot whose weights stay 0
HIDDEN = 0.7  # share of the features that training does not see

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")  # its parts, four at a time, are the matches of [0-9]+(\.[0-9]+){3}
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
MARKED = re.compile(r"[0-9@]")
RUN = re.compile(r"[0-9A-Za-z._%@-]+")
GAP = re.compile(r"[\x20().+/_:-]{0,3}")  # what may stand between the tokens of one number
_RUN = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%@-")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_NOT_DIGIT = re.compile(r"[^0-9]")
_TELLING = re.compile(r"[._%+-]|[0-9]")  # a local part without one of these may be any word

Span = tuple[int, int, int]  # start, end, kind


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The matches of EMAIL, tried only near at signs: a match starts at the first character of the run that ends at its at sign, but
    not inside an earlier match."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        match = EMAIL.match(text, start) if start < at else None
        if match:
            yield match.span()
            done = match.end()
        at = text.find("@", max(at + 1, done))


def _byte(digits: str) -> bool:
    return len(own := digits.lstrip("0")) <= 3 and int(own or 0) <= 255


def tokens(text: str) -> list[tuple[int, int]]:
    """The runs of characters of tokens that hold a digit or an at sign, without full stops and hyphens at their ends."""
    out, done = [], 0
    while m := MARKED.search(text, done):
        a = m.start()
        while a > done and text[a - 1] in _RUN:
            a -= 1
        done = RUN.match(text, a).end()
        b = done
        while text[a] in ".-":
            a += 1
        while text[b - 1] in ".-":
            b -= 1
        out.append((a, b))
    return out


def base_spans(text: str) -> list[Span]:
    found: list[Span] = []
    if "@" in text:
        found += [(a, b, 0) for a, b in _emails(text)]
    for m in DOTTED.finditer(text) if "." in text else ():
        if m[0].count(".") >= 3:
            at, parts = m.start(), m[0].split(".")
            for i in range(0, len(parts) - 3, 4):
                four = parts[i : i + 4]
                end = at + sum(map(len, four)) + 3
                if all(_byte(p) for p in four):
                    found.append((at, end, 1))
                at = end + 1
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            found.append((*m.span(), 2))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                found.append((*m.span(), 3))
    return sorted(found, key=lambda s: (s[0], s[2]))


def show(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def _shape(token: str) -> str:
    return re.sub(r"(.)\1+", r"\1", re.sub(r"[A-Za-z]", "a", re.sub(r"[0-9]", "0", token)))


def _features(text: str, a: int, b: int) -> list[int]:
    """Slots of the token's features, slot 0 for the bias.  Long tokens are told by their first 64 characters and their length."""
    token = text[a : min(b, a + 64)]
    digits = _NOT_DIGIT.sub("", token)
    parts = token.split(".")
    told = [
        f"shape {_shape(token)}",
        f"digits {min(len(digits), 20)}",
        f"dots {min(token.count('.'), 4)} {'@' in token}",
        f"luhn {14 <= len(digits) <= 19 and luhn(digits)}",
        f"quad {len(parts) == 4 and all(p.isdigit() and _byte(p) for p in parts)}",
        f"before {_shape(text[max(0, a - 2) : a])}",
        f"after {_shape(text[b : b + 2])}",
        f"length {min(b - a, 64) // 4} {token.isdigit()}",
    ]
    return [0, *(1 + zlib.crc32(t.encode()) % (SLOTS - 2) for t in told)]


def _numbers(digits: str) -> set[str]:
    """Forms of a number."""
    return {f"#{digits}", f"..{digits[-SUFFIX:]}"} if len(digits) >= SUFFIX else {f"#{digits}"} if len(digits) >= 5 else set()


def _forms(token: str) -> set[str]:
    """Forms of an address or a number in one token."""
    token = token.lower()
    if "@" in token:
        local, _, rest = token.partition("@")
        return {f"@{token}", *([f"{local}@"] if len(local) >= 3 else []), *([f"@{rest.split('.')[0]}@{local}"] if rest else [])}
    return _numbers(_NOT_DIGIT.sub("", token))


class Graph:
    """Nodes and edges of one document.  ``spans`` are mentions; entities
    follow them as nodes without features; ``observed`` is the label of each node, -1 where it is to be found."""

    def __init__(self, text: str, base: list[Span]) -> None:
        own: list[tuple[int, int, int]] = []
        for a, b, kind in base:
            if not own or a >= own[-1][1]:  # of base spans that overlap, the first is the node
                own.append((a, b, kind + 1))
        free = tokens(text)
        locals_ = {text[a:b].lower().partition("@")[0] for a, b, k in own if k == 1}
        for local in sorted(x for x in locals_ if len(x) >= 5 and _TELLING.search(x)):
            for m in re.finditer(r"(?<![0-9A-Za-z._%+@-])" + re.escape(local) + r"(?![0-9A-Za-z_%@+-])", text, re.I):
                free.append(m.span())
        taken, at = [], 0
        for a, b in sorted(set(free)):
            while at < len(own) and own[at][1] <= a:
                at += 1
            if not (at < len(own) and own[at][0] < b) and not (taken and taken[-1][1] > a):
                taken.append((a, b, -1))
        every = sorted(own + taken)
        self.spans = [(a, b) for a, b, _ in every]
        self.observed = np.array([k for *_, k in every], int)
        self.chain = [(i, i + 1) for i in range(len(every) - 1) if every[i][2] < 0 and every[i + 1][2] < 0 and every[i + 1][0] - every[i][1] <= 3 and GAP.fullmatch(text, every[i][1], every[i + 1][0])]
        self.skip: list[tuple[int, int]] = []
        self.entities: dict[str, int] = {}
        joined = set(self.chain)
        runs, i = [], 0
        while i < len(every):
            j = i
            while (j, j + 1) in joined and j - i < 8:
                j += 1
            runs.append((i, j + 1))
            i = j + 1
        mentions: dict[str, list[int]] = {}
        entity: list[int] = []
        for i, j in runs:
            whole = _numbers("".join(_NOT_DIGIT.sub("", text[a:b]) for a, b, _ in every[i:j])) if j - i > 1 else set()
            for n in range(i, j):
                a, b, _ = every[n]
                forms = _forms(text[a:b]) | whole | ({f"{text[a:b].lower()}@"} if text[a:b].lower() in locals_ else set())
                for form in forms:
                    mentions.setdefault(form, []).append(n)
        for form in sorted(mentions):
            if len(mentions[form]) > 1:
                node = len(every) + len(self.entities)
                self.entities[form] = node
                self.skip += [(n, node) for n in mentions[form]]
                known = {every[n][2] for n in mentions[form] if every[n][2] > 0}
                entity.append(known.pop() if len(known) == 1 else -1)
        self.observed = np.append(self.observed, np.array(entity, int))
        self.features = [_features(text, a, b) for a, b, _ in every]


class Field:
    """Weights: unary (slot, label), and for chain and skip edges each one for two O's and one for the same kind."""

    def __init__(self) -> None:
        self.unary = np.zeros((SLOTS, len(KINDS) + 1))
        self.edge = np.zeros((2, 2))  # chain, skip; both O, same kind

    def pairs(self) -> np.ndarray:
        """The potentials (chain or skip, label, label) in log space."""
        size = len(KINDS) + 1
        out = np.zeros((2, size, size))
        out[:, np.arange(1, size), np.arange(1, size)] = self.edge[:, 1, None]
        out[:, 0, 0] = self.edge[:, 0]
        return out

    def fit(self, label: np.ndarray, slots: np.ndarray, near: np.ndarray, epochs: int = 200, rate: float = 0.3) -> None:
        """Pseudo-likelihood by full-batch AdaGrad.  ``near[:, e, k]`` is the number of neighbours over chain (e = 0) or skip edges (1)
        with label k, taken as given.  Labelled nodes and O's weigh the same in total."""
        if not len(label) or not (label > 0).any():
            return
        size = len(KINDS) + 1
        y = np.eye(size)[label]
        weight = np.where(label > 0, 0.5 / (label > 0).sum(), 0.5 / max((label == 0).sum(), 1))[:, None]
        parts = [self.unary, self.edge]
        square = [np.full_like(p, 1e-8) for p in parts]
        for _ in range(epochs):
            s = self.unary[slots].sum(axis=1)
            for e in (0, 1):
                s = s + near[:, e] * np.append(self.edge[e, 0], np.full(size - 1, self.edge[e, 1]))
            p = np.exp(s - s.max(axis=1, keepdims=True))
            off = (p / p.sum(axis=1, keepdims=True) - y) * weight
            unary = np.stack([np.bincount(slots.ravel(), np.repeat(off[:, k], slots.shape[1]), SLOTS) for k in range(size)], axis=1)
            unary[NOTHING] = 0
            told = off[:, None, :] * near
            edge = np.stack([told[:, :, 0].sum(axis=0), told[:, :, 1:].sum(axis=(0, 2))], axis=1)
            for part, g, total in zip(parts, [unary + 1e-3 * self.unary, edge + 1e-5 * self.edge], square, strict=True):
                total += g * g
                part -= rate * g / np.sqrt(total)

    def marginals(self, g: Graph) -> np.ndarray:
        """Loopy belief propagation in log space to convergence; entities come after the mentions."""
        n = len(g.spans)
        log = np.zeros((n + len(g.entities), len(KINDS) + 1))
        if n:
            log[:n] = self.unary[np.array(g.features)].sum(axis=1)
            seen = np.flatnonzero(g.observed >= 0)
            log[seen] = -60.0
            log[seen, g.observed[seen]] = 0.0
        edges = [(a, b, 0) for a, b in g.chain] + [(a, b, 1) for a, b in g.skip]
        if edges:
            e = np.array(edges)
            source, target = np.concatenate([e[:, 0], e[:, 1]]), np.concatenate([e[:, 1], e[:, 0]])
            back = np.concatenate([np.arange(len(e)) + len(e), np.arange(len(e))])
            pair = self.pairs()[np.concatenate([e[:, 2], e[:, 2]])]
            message = np.zeros((len(source), log.shape[1]))
            turn = 0
            while True:
                belief = log.copy()
                np.add.at(belief, target, message)
                inner = (belief[source] - message[back])[:, :, None] + pair
                top = inner.max(axis=1, keepdims=True)
                new = (top + np.log(np.exp(inner - top).sum(axis=1, keepdims=True)))[:, 0, :]
                step = (new - new.max(axis=1, keepdims=True)) - message
                message = message + step * min(0.7, 30 / (turn + 1))
                turn += 1
                if np.abs(step).max() * min(1.0, 30 / turn) < STILL:
                    break
            np.add.at(log, target, message)
        p = np.exp(log - log.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def added_spans(text: str, base: list[Span], field: Field) -> list[Span]:
    """Spans that the field finds beside the base spans, never overlapping them."""
    if not field.edge.any() or not MARKED.search(text):
        return []
    g = Graph(text, base)
    if (g.observed[: len(g.spans)] > 0).all():
        return []
    p = field.marginals(g)
    best = p.argmax(axis=1)
    found: list[list[int]] = []
    chained = {b for _, b in g.chain}
    for i, (a, b) in enumerate(g.spans):
        if g.observed[i] < 0 and best[i] and 1 - p[i, 0] >= SURE:
            if found and i in chained and found[-1][3] == i - 1 and found[-1][2] == best[i] - 1:
                found[-1][1], found[-1][3] = b, i
            else:
                found.append([a, b, int(best[i]) - 1, i])
    return [(a, b, k) for a, b, k, _ in found if not any(a < y and x < b for x, y, _ in base)]


def another_form(mention: str, kind: int, rng: random.Random) -> str:
    """A mention as a document may repeat it."""
    digits = _NOT_DIGIT.sub("", mention)
    if kind == 0:
        local, _, rest = mention.partition("@")
        return rng.choice([f"{local}@{rest.split('.')[0]}", f"{local} at {rest}" if len(local) >= 5 and _TELLING.search(local) else f"{local}@{rest.split('.')[0]}"])
    if kind == 1:
        return rng.choice("-_").join(mention.split("."))
    if kind == 2:
        return rng.choice("./_").join(digits[i : i + 4] for i in range(0, len(digits), 4))
    last = digits[-10:]
    return rng.choice([f"{last[:3]}-{last[3:6]}-{last[6:]}", f"({last[:3]}) {last[3:6]}-{last[6:]}", f"{last[-7:-4]}-{last[-4:]}", last, f"{last[:3]}.{last[3:6]}.{last[6:]}"])


def planted(text: str, base: list[Span], rng: random.Random, share: float = 0.7) -> tuple[str, list[Span]]:
    """The text with repeats of some base spans in other forms put in at spaces, and the places of these."""
    spaces = [m.start() for m in re.finditer(" ", text) if not any(a - 8 <= m.start() < b + 8 for a, b, _ in base)]
    out, marks, at = [], [], 0
    wanted = [(text[a:b], k) for a, b, k in base if rng.random() < share]
    size = 0
    for place, (mention, kind) in zip(sorted(rng.sample(spaces, min(len(spaces), len(wanted)))), wanted, strict=False):
        form = another_form(mention, kind, rng)
        piece = text[at : place + 1]
        out += [piece, form]
        size += len(piece)
        marks.append((size, size + len(form), kind))
        size += len(form)
        at = place
    return "".join([*out, text[at:]]), marks


def labelled_nodes(text: str, seed: int) -> list[tuple[int, list[int], np.ndarray]]:
    """(label, slots, counts of neighbours' labels) of the nodes of one document that can teach: planted mentions, and tokens that share no
    form with a base span."""
    rng = random.Random(seed)
    text, marks = planted(text, base_spans(text), rng)
    base = [s for s in base_spans(text) if not any(a < s[1] and s[0] < b for a, b, _ in marks)]
    g = Graph(text, base)
    n = len(g.spans)
    label = np.append(g.observed[:n], np.full(len(g.entities), -1))
    for a, b, kind in marks:
        for i, (x, y) in enumerate(g.spans):
            if x < b and a < y and label[i] < 0:
                label[i] = kind + 1
    # an entity is what its labelled mentions are; other mentions of such an entity are unlabelled, all the rest is O
    linked = {}
    for i, node in g.skip:
        if label[i] > 0:
            linked[node] = label[i]
    for node, k in linked.items():
        label[node] = k
    open_ = {i for i, node in g.skip if label[i] < 0 and node in linked}
    label[[i for i in range(len(label)) if label[i] < 0 and i not in open_]] = 0
    near = np.zeros((len(label), 2, len(KINDS) + 1))
    for e, edges in enumerate((g.chain, g.skip)):
        for a, b in edges:
            if label[b] >= 0:
                near[a, e, label[b]] += 1
            if label[a] >= 0:
                near[b, e, label[a]] += 1
    hide = lambda slots: [slots[0], *(NOTHING if rng.random() < HIDDEN else x for x in slots[1:])]
    return [(int(label[i]), hide(g.features[i]), near[i]) for i in range(n) if g.observed[i] < 0 and i not in open_]


def _teach(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        for text in part.column("text").to_pylist():
            found = tokens(text)
            if found:
                own = text[max(0, found[0][0] - 200) : found[-1][1] + 200]  # all tokens lie in it
                rows = [r for i in range(PLANTINGS) for r in labelled_nodes(own, zlib.crc32(own.encode()) + i)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.list_(pa.int32())), pa.array([r[2].ravel() for r in rows], pa.list_(pa.float64()))], names=["label", "slots", "near"])


def train(docs: DataFrame, max_rows: int = MAX_ROWS, max_nodes: int = MAX_NODES) -> Field:
    """Fit on the tokens of about ``max_rows`` documents; one task learns from about ``max_nodes`` labelled tokens and as many others."""
    few = hash_sample(docs.where(F.col("text").isNotNull()).select("doc_id", "text"), F.xxhash64("doc_id", "text"), 17, max_rows)
    nodes = materialize(few.select("text").mapInArrow(_teach, "label int, slots array<int>, near array<double>"), "pii-nodes")
    # tokens that agree in all that is learned from are counted, so a repeated one costs one row
    alike = nodes.groupBy("label", "slots", "near").agg(F.count(F.lit(1)).alias("times"))
    key = F.xxhash64("label", "slots", "near")
    some = hash_sample(alike.where("label > 0"), key, 18, max_nodes).unionByName(hash_sample(alike.where("label = 0"), key, 19, max_nodes))

    def learn(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns: list[list] = [[], [], []]
        for part in parts:
            for column, name in zip(columns, ("label", "slots", "near"), strict=True):
                column += part.column(name).to_pylist()
        order = sorted(range(len(columns[0])), key=lambda i: tuple(c[i] for c in columns))
        model = Field()
        if order:
            near = np.array([columns[2][i] for i in order]).reshape(len(order), 2, len(KINDS) + 1)
            model.fit(np.array([columns[0][i] for i in order]), np.array([columns[1][i] for i in order]), near)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    row = some.select("label", "slots", "near").repartition(1).mapInArrow(learn, "model binary").first()
    return pickle.loads(row[0]) if row else Field()


def find_personal_data(docs: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added for every row."""
    bounded_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, max_rows))  # a few thousand weights

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        for part in parts:
            rows = []
            for text in part.column("text").to_pylist():
                base = base_spans(text) if text else []
                more = added_spans(text, base, field) if text else []
                every = sorted(base + more, key=lambda s: (s[0], s[2]))
                rows.append((*(sum(s[2] == k for s in base) for k in range(4)), hashlib.sha256(show(base).encode()).hexdigest(), show(every), len(more)))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds))], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    return docs.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
