"""Secrets in text: fixed rules, and formats learned from the credentials that the rules find.

A sample of the values found by each rule (the ``SAMPLE`` distinct ones with the smallest hash, a documented bound) is
put into a prefix tree over character classes. States whose continuations are statistically compatible (Hoeffding
bounds) are merged until a small probabilistic automaton is left for each rule. Every run of ``LEAST`` or more
characters that values of the assign rule may hold is then scored by its likelihood per character under the automata against the better of two
explanations: random characters, and the corpus's own words, whose letter pairs are counted over all documents outside the rules' spans.
Runs are scored without the dots around them; so are their pieces between dots.
Tokens at or above ``THRESHOLD`` bits that no rule has found become spans too, pieces only where the whole does not.

The automata are fitted on the first ``FITTED`` characters of a value, so that their trees are bounded; all tokens are scored whole.
Null and empty texts have no secrets. Repeated rows each get their own result. Without any credential nothing is learned and only
the rules apply; without any words only random characters stand against a format.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datalumen.llm.common import SLICE_BYTES, documents, key, marked, slices, unused
from datalumen.session import checkpointed

SAMPLE, FITTED, CONFIDENCE, THRESHOLD, LONG, LEAST = 300, 256, 0.05, 0.5, 16, 12
KINDS = ("assign", "access", "hex", "format")
MASK = "[secret]"

_ASSIGN = re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_WORDS = (b"passw", b"secret", b"token", b"api")
_HEX = np.isin(np.arange(256), list(b"0123456789abcdef"))
_TOKEN = np.isin(np.arange(256), list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"))

#: Per byte: 1 to 26 for letters of either case, else 0.
_LETTER = np.zeros(256, dtype=np.int64)
_LETTER[97:123] = _LETTER[65:91] = np.arange(1, 27)
_CAPITAL = np.isin(np.arange(256), np.arange(65, 91))
_NO_WORD = np.isin(np.arange(256), list(b"0123456789+_="))

# -- candidates -----------------------------------------------------------------------------------------------------


def _runs(inside: np.ndarray, bounds: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of at least ``least`` places, cut at the bounds of texts."""
    edge = np.zeros(len(inside) + 1, dtype=bool)
    edge[bounds] = True
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:len(inside)]
    ends[:-1] &= ~inside[1:] | edge[1:len(inside)]
    start, stop = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    long = stop - start >= least
    return start[long], stop[long]


def _pieces(raw: bytes, start: int, stop: int) -> Iterator[tuple[int, int]]:
    """A run without the dots around it, then its pieces between dots."""
    value = raw[start:stop]
    if b"." not in value:
        yield start, stop
        return
    a, b = stop - len(value.lstrip(b".")), start + len(value.rstrip(b"."))
    if b - a >= LEAST:
        yield a, b
    if b"." in raw[a:b]:
        for piece in raw[a:b].split(b"."):
            if len(piece) >= LEAST:
                yield a, a + len(piece)
            a += len(piece) + 1


def _letter_pairs(data: np.ndarray, bounds: np.ndarray, known: np.ndarray) -> np.ndarray:
    """How often one letter follows another (or begins a word, after 0) in plain words, as ``27 * first + second``; rule spans are left out.

    Plain words are in runs without digits and ``+_=`` and have capitals at their beginning only.
    """
    token, letter = _TOKEN[data], _LETTER[data]
    before = np.zeros(len(data), dtype=np.int64)
    before[1:] = letter[:-1]
    before[bounds[:-1][bounds[:-1] < len(data)]] = 0
    odd = np.concatenate(([0], np.cumsum(known | _NO_WORD[data] | (_CAPITAL[data] & (before > 0)))))
    start, stop = _runs(token, bounds, 1)
    plain = odd[stop] == odd[start]
    use = marked(len(data), start[plain], stop[plain]) & (letter > 0)
    return np.bincount(before[use] * 27 + letter[use], minlength=27 * 27)


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, row_key, found, tokens, pairs``: rule spans ``kind, start, stop, value`` and the tokens to score, in code points.

    ``pairs`` are the letter pairs of a slice of rows, held by its first row.
    """
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("value", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in slices(batches):
            data, bounds = texts.data, texts.bounds
            points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
            raw = data.tobytes()
            found: list[list] = [[] for _ in range(len(texts))]
            tokens: list[list] = [[] for _ in range(len(texts))]
            known = np.zeros(len(data), dtype=bool)

            def add(to: list, i: int, kind: str, start: int, stop: int, value: bytes) -> None:
                base = points[bounds[i]]
                if to is found:
                    known[start:stop] = True
                to[i].append({"kind": kind, "start": int(points[start] - base), "stop": int(points[stop] - base), "value": value.decode()})

            lowered = raw.lower()
            if any(w in lowered for w in _WORDS) or b"AKIA" in raw:
                for i in range(len(texts)):
                    a, b = int(bounds[i]), int(bounds[i + 1])
                    own, low = raw[a:b], lowered[a:b]
                    if any(w in low for w in _WORDS):
                        for m in _ASSIGN.finditer(own):
                            if m.end(1) - m.start(1) >= LEAST:
                                add(found, i, "assign", a + m.start(), a + m.end(), m[1])
                    if b"AKIA" in own:
                        for m in _ACCESS.finditer(own):
                            if m.end() - m.start() >= 18:
                                add(found, i, "access", a + m.start(), a + m.end(), m[0])
            for inside, to, kind, least in ((_HEX, found, "hex", LONG), (_TOKEN, tokens, "format", LEAST)):
                start, stop = _runs(inside[data], bounds, least)
                row = np.searchsorted(bounds, start, side="right") - 1
                for i, s, e in zip(row.tolist(), start.tolist(), stop.tolist()):
                    for a, b in _pieces(raw, s, e) if kind == "format" else ((s, e),):
                        add(to, i, kind, a, b, raw[a:b])
            counts = _letter_pairs(data, bounds, known)
            seen = np.flatnonzero(counts)
            pairs = [[{"pair": p, "n": n} for p, n in zip(seen.tolist(), counts[seen].tolist())], *[[]] * (len(texts) - 1)]
            yield pa.RecordBatch.from_arrays([
                texts.rows.column("doc_id"), texts.rows.column("row_key"),
                pa.array([sorted(x, key=lambda s: (s["start"], KINDS.index(s["kind"]))) for x in found], pa.list_(span)),
                pa.array(tokens, pa.list_(span)), pa.array(pairs, pa.list_(pa.struct([("pair", pa.int32()), ("n", pa.int64())])))],
                names=["doc_id", "row_key", "found", "tokens", "pairs"])

    spans = "array<struct<kind:string,start:bigint,stop:bigint,value:string>>"
    return key(documents(docs)).mapInArrow(run, f"doc_id bigint, row_key bigint, found {spans}, tokens {spans}, pairs array<struct<pair:int,n:bigint>>")


# -- formats --------------------------------------------------------------------------------------------------------

# The classes of characters that formats are made of, with their sizes in bits.
_CLASSES = {"d": "0123456789", "h": "abcdef", "l": "ghijklmnopqrstuvwxyz", "H": "ABCDEF", "U": "GHIJKLMNOPQRSTUVWXYZ"}
_CLASS = {c: k for k, cs in _CLASSES.items() for c in cs}
_BITS = {k: math.log2(len(cs)) for k, cs in _CLASSES.items()}
_RANDOM_BITS = 6.0
_SMOOTHED = 5.0
_UNSEEN = 2.0 ** -13


class Format:
    """A probabilistic automaton learned from strings by merging compatible states of their prefix tree."""

    def __init__(self, values: list[str], confidence: float = CONFIDENCE):
        self.n, self.ends, self.next, self.uses = [0], [0], [{}], [{}]
        self.dotted = any("." in v.strip(".") for v in values)
        self._bound = math.sqrt(0.5 * math.log(2 / confidence))
        for value in values:
            state = 0
            for c in value[:FITTED]:
                c = _CLASS.get(c, c)
                self.n[state] += 1
                self.uses[state][c] = self.uses[state].get(c, 0) + 1
                if c not in self.next[state]:
                    self.next[state][c] = len(self.n)
                    self.n.append(0), self.ends.append(0), self.next.append({}), self.uses.append({})
                state = self.next[state][c]
            self.n[state] += 1
            self.ends[state] += len(value) <= FITTED
        self._merge_all()

    def _differs(self, x: int, n: int, y: int, m: int) -> bool:
        return abs(x / n - y / m) > self._bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def _compatible(self, a: int, b: int) -> bool:
        """Whether the two states and what follows them may have one distribution."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n, m = self.n[a], self.n[b]
            if a == b or not n or not m:
                continue
            if self._differs(self.ends[a], n, self.ends[b], m):
                return False
            for c in self.uses[a].keys() | self.uses[b].keys():
                if self._differs(self.uses[a].get(c, 0), n, self.uses[b].get(c, 0), m):
                    return False
                if c in self.next[a] and c in self.next[b]:
                    todo.append((self.next[a][c], self.next[b][c]))
        return True

    def _fold(self, a: int, b: int) -> None:
        """Add the tree below ``b`` to the automaton at ``a``."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.n[a] += self.n[b]
            self.ends[a] += self.ends[b]
            for c, used in self.uses[b].items():
                self.uses[a][c] = self.uses[a].get(c, 0) + used
                if c in self.next[a]:
                    todo.append((self.next[a][c], self.next[b][c]))
                else:
                    self.next[a][c] = self.next[b][c]

    def _merge_all(self) -> None:
        """Keep the states that differ from all kept ones; fold every other into the first that it is compatible with."""
        kept, at = [0], 0
        while at < len(kept):
            for c in sorted(self.next[kept[at]]):
                state = self.next[kept[at]][c]
                if state in kept:
                    continue
                for to in kept:
                    if self._compatible(to, state):
                        self.next[kept[at]][c] = to
                        self._fold(to, state)
                        break
                else:
                    kept.append(state)
            new = [s for k in kept[:at + 1] for s in self.next[k].values() if s not in kept]  # folding can uncover states behind
            at = at + 1 if not new else 0
        self.states = kept

    def bits(self, value: str) -> float:
        """The logarithm of a token's likelihood; none if only the token has dots inside."""
        if "." in value and not self.dotted:
            return -math.inf
        state, total = 0, 0.0
        for c in value:
            k = _CLASS.get(c, c)
            used = self.uses[state].get(k, 0) if state is not None else 0
            share = used / self.n[state] if used else _UNSEEN
            total += math.log2(share) - _BITS.get(k, 0.0)
            state = self.next[state][k] if used else 0
        return total


class Plain:
    """What a token is if it is no credential: random characters, or words by the letter pairs of the corpus with random signs between."""

    def __init__(self, pairs: dict[int, int]):
        n = np.zeros(27 * 27)
        n[list(pairs)] = list(pairs.values())
        n = n.reshape(27, 27)
        letters = (n.sum(axis=0) + 1) / (n.sum() + 26)
        self.table = np.log2((n + _SMOOTHED * letters) / (n.sum(axis=1, keepdims=True) + _SMOOTHED))

    def bits(self, value: str) -> float:
        code = _LETTER[np.frombuffer(value.encode(), dtype=np.uint8)]
        words = self.table[np.concatenate(([0], code[:-1])), code]
        return max(-_RANDOM_BITS * len(code), float(np.where(code > 0, words, -_RANDOM_BITS).sum()))


def learn(scanned: DataFrame, sample: int = SAMPLE) -> dict[str, Format]:
    """One automaton for each rule, from the first ``FITTED`` characters of its ``sample`` values with the smallest hashes."""
    cut = F.substring("s.value", 1, FITTED + 1).alias("value")
    values = scanned.select(F.explode("found").alias("s")).select("s.kind", cut).distinct()
    out = {}
    for kind in KINDS[:3]:
        rows = values.where(F.col("kind") == kind).orderBy(F.xxhash64("value"), "value").limit(sample).collect()
        if rows:
            out[kind] = Format(sorted(r.value for r in rows))
    return out


def plain_words(scanned: DataFrame) -> Plain:
    """The word model of all documents, from at most 729 counted letter pairs."""
    pairs = scanned.select(F.explode("pairs").alias("p")).groupBy("p.pair").agg(F.sum("p.n").alias("n"))
    return Plain({r.pair: r.n for r in pairs.collect()})


def find_secrets(docs: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, row_key, found, added, best``: rule spans, spans of learned formats, and the highest score of a token."""
    scanned = checkpointed(scan(docs))
    formats = learn(scanned, sample)
    plain = plain_words(scanned)
    added_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("score", pa.float64())]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            added, best = [], []
            for found, tokens in zip(batch.column("found").to_pylist(), batch.column("tokens").to_pylist()):
                values = [t["value"] for t in tokens] if formats else []
                scores = [(max(f.bits(v) for f in formats.values()) - plain.bits(v)) / len(v) for v in values]
                taken = iter(found)
                own, current, end = [], next(taken, None), 0
                for t, s in zip(tokens, scores):  # both in page order, whole runs before their pieces; rule spans of one start may overlap
                    while current and current["stop"] <= t["start"]:
                        current = next(taken, None)
                    if s >= threshold and t["start"] >= end and not (current and current["start"] < t["stop"]):
                        end = t["stop"]
                        own.append({"kind": "format", "start": t["start"], "stop": t["stop"], "score": s})
                added.append(own)
                best.append(max((s for s in scores if s > -math.inf), default=None))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("row_key"), batch.column("found"), pa.array(added, added_type),
                pa.array(best, pa.float64())], names=["doc_id", "row_key", "found", "added", "best"])

    return scanned.drop("pairs").mapInArrow(score, "doc_id bigint, row_key bigint, found array<struct<kind:string,start:bigint,stop:bigint,value:string>>, "
                                     "added array<struct<kind:string,start:bigint,stop:bigint,score:double>>, best double")


def secret_report(docs: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans, best_score`` of every document."""
    found = find_secrets(docs, sample, threshold)
    plain = "array<struct<kind:string,start:bigint,stop:bigint>>"
    base = F.transform("found", lambda s: F.struct(s["kind"], s["start"], s["stop"])).cast(plain)
    more = F.transform("added", lambda s: F.struct(s["kind"], s["start"], s["stop"])).cast(plain)
    order = F.array(*map(F.lit, KINDS))
    ordered = F.array_sort(F.transform(F.concat(base, more), lambda s: F.struct(
        s["start"].alias("start"), F.array_position(order, s["kind"]).alias("k"), s["stop"].alias("stop"), s["kind"].alias("kind"))))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")

    def count(kind: str):
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select(
        "doc_id", *[count(k) for k in KINDS[:3]],
        F.sha2(joined(base), 256).alias("base_sha256"), joined(ordered).alias("spans"), F.col("best").alias("best_score"))


def masked(text: str, spans: list[tuple[int, int]], mask: str = MASK) -> str:
    """The text with each group of overlapping spans replaced."""
    out, at = [], 0
    for start, stop in sorted(spans):
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, stop)
    return "".join([*out, text[at:]])


def mask_secrets(docs: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """All documents, all columns, with their secrets replaced (``n_chars`` follows the text)."""
    found = find_secrets(docs, sample, threshold).where((F.size("found") > 0) | (F.size("added") > 0))
    name, spans = unused(docs, "row_key"), unused(docs, "spans")
    both = F.concat(*[F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"))) for c in ("found", "added")])
    found = checkpointed(found.select(F.col("row_key").alias(name), both.alias(spans)).dropDuplicates([name]))
    keyed = docs.withColumn(name, F.xxhash64(docs["doc_id"].cast("bigint"), docs["text"].cast("string")))
    joined = keyed.join(found, name, "left")
    place = joined.columns.index("text")

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in slices(batches, limit=4 * SLICE_BYTES):
            out = [masked(t, [(s["start"], s["stop"]) for s in x]) if x else t
                   for t, x in zip(texts.rows.column("text").to_pylist(), texts.rows.column(spans).to_pylist())]
            yield texts.rows.set_column(place, "text", pa.array(out, texts.rows.schema.field("text").type))

    out = joined.mapInArrow(replace, joined.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(spans).isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*[out[c] for c in docs.columns])
