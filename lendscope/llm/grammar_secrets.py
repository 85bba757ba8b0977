"""Secret scans with inferred grammars.

Base kinds are the three patterns of the result contract.  On top, a probabilistic automaton is
inferred for each kind from labelled credentials (values that the base patterns found): a prefix
tree of their character classes is folded by merging states whose arrival counts, stop rates and
next-symbol rates do not differ by a Hoeffding test (and whose merged subtrees do not either).
Every candidate - an unbroken run of CANDIDATE characters with a digit, outside the base spans -
is scored by its likelihood per symbol under each automaton against a uniform source; it becomes a
``format`` span when some automaton gives at least what all but 2 % of that kind's own
credentials get.

Fit: the PER_KIND credentials of each kind that are first by hash, out of all rows (a bound on
fitting only; every row and whole text is scanned).

Defined results: a null text is empty and has no spans; rows keep their multiplicity; with too few
credentials of a kind no automaton of it is used; an empty table gives an empty result; only the
named columns are used.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Patterns, least lengths and kinds (fixed by the result contract).
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")   # a run is matched whole, so runs of 24 and more are the ones that stay
KINDS = ("assign", "access", "hex", "format")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
DIGIT = re.compile(r"[0-9]")
PER_KIND = 400
SALTS = 64
MIN_CREDENTIALS = 20
CONFIDENCE = 0.05


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, by start, then kind as listed."""
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def credentials(text: str) -> list[tuple[str, str]]:
    """(kind, value) of the labelled credentials of a text."""
    out = [("assign", m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [("access", m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    return out + [("hex", m[0]) for m in HEX.finditer(text)]


_CLASS = str.maketrans({**{c: "h" for c in "abcdef"}, **{c: "l" for c in "ghijklmnopqrstuvwxyz"},
                        **{c: "A" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}, **{c: "9" for c in "0123456789"}})
#: How many characters each symbol stands for; all others stand for themselves.
_WIDTH = {"h": 6, "l": 20, "A": 26, "9": 10}
_ALPHABET = 68


class Automaton:
    """Probabilistic automaton over character classes."""

    def __init__(self, values: list[str], confidence: float = CONFIDENCE):
        self.n, self.stop, self.next = [0], [0], [{}]
        for v in values:
            s = 0
            for c in v.translate(_CLASS):
                self.n[s] += 1
                if c not in self.next[s]:
                    self.next[s][c] = [len(self.n), 0]
                    self.n.append(0)
                    self.stop.append(0)
                    self.next.append({})
                self.next[s][c][1] += 1
                s = self.next[s][c][0]
            self.n[s] += 1
            self.stop[s] += 1
        self._bound = math.sqrt(0.5 * math.log(2 / confidence))
        self._fold()

    def _differs(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return n1 > 0 and n2 > 0 and abs(f1 / n1 - f2 / n2) > self._bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def _compatible(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            if self._differs(self.stop[a], self.n[a], self.stop[b], self.n[b]):
                return False
            for c in {*self.next[a], *self.next[b]}:
                x, y = self.next[a].get(c), self.next[b].get(c)
                if self._differs(x[1] if x else 0, self.n[a], y[1] if y else 0, self.n[b]):
                    return False
                if x and y:
                    todo.append((x[0], y[0]))
        return True

    def _merge(self, a: int, b: int) -> None:
        """Adds tree state b, and what hangs below, onto a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.n[a] += self.n[b]
            self.stop[a] += self.stop[b]
            for c, (to, f) in self.next[b].items():
                if c in self.next[a]:
                    self.next[a][c][1] += f
                    todo.append((self.next[a][c][0], to))
                else:
                    self.next[a][c] = [to, f]

    def _fold(self) -> None:
        """Red states are settled; each fringe state merges into the first compatible one or gets red."""
        red = [0]
        while True:
            fringe = [(-self.n[e[0]], c, s, e) for s in red for c, e in self.next[s].items() if e[0] not in red]
            if not fringe:
                break
            *_, edge = min(fringe, key=lambda x: (x[0], x[2], x[1]))
            for r in red:
                if self._compatible(r, edge[0]):
                    b, edge[0] = edge[0], r
                    self._merge(r, b)
                    break
            else:
                red.append(edge[0])
        self.states = len(red)

    def score(self, value: str) -> float:
        """Log-likelihood ratio per character against a uniform source over _ALPHABET characters."""
        s, out, k = 0, 0.0, len(value)
        for c in value.translate(_CLASS):
            e = self.next[s].get(c)
            if e is None:
                return -math.inf
            out += math.log(e[1] / self.n[s] / _WIDTH.get(c, 1) * _ALPHABET)
            s = e[0]
        return (out + math.log(max(self.stop[s], 0.5) / self.n[s])) / max(1, k)


def infer(labelled: list[tuple[str, str]]) -> list[tuple[Automaton, float]]:
    """An automaton and its least score for each kind with enough credentials."""
    by = defaultdict(list)
    for kind, value in sorted(set(labelled)):
        by[kind].append(value)
    out = []
    for kind in sorted(by):
        values = sorted(by[kind], key=lambda v: hashlib.md5(v.encode()).digest())[:PER_KIND]
        if len(values) >= MIN_CREDENTIALS:
            a = Automaton(values)
            scores = sorted(a.score(v) for v in values)
            out.append((a, scores[len(scores) // 50]))
    return out


def first_by_hash(found: dict[str, dict[str, str]]) -> None:
    """Of each kind the PER_KIND first values by hash stay."""
    for kind, values in found.items():
        if len(values) > PER_KIND:
            found[kind] = dict(sorted(values.items(), key=lambda x: x[1])[:PER_KIND])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[Automaton, float]]:
    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[str, dict[str, str]] = {k: {} for k in KINDS}
        for b in batches:
            for t in b["text"]:
                for kind, value in credentials(t):
                    # format lengths are short; a longer value would only make the prefix tree deeper
                    if len(value) <= 256:
                        found[kind][value] = hashlib.md5(value.encode()).hexdigest()
                if any(len(v) > 4 * PER_KIND for v in found.values()):
                    first_by_hash(found)
        first_by_hash(found)
        yield pd.DataFrame([(k, v, h) for k, values in found.items() for v, h in values.items()],
                           columns=["kind", "value", "h"])

    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"))
    # at most PER_KIND of each kind from a task; equal values meet by hash, then again PER_KIND of each kind and salt
    found = rows.mapInPandas(find, "kind string, value string, h string").distinct()
    salt = F.pmod(F.xxhash64("value"), F.lit(SALTS))
    for of in (["kind", salt], ["kind"]):
        found = found.withColumn("r", F.row_number().over(Window.partitionBy(*of).orderBy("h", "value"))).where(
            F.col("r") <= PER_KIND).drop("r")
    return infer([(r["kind"], r["value"]) for r in found.collect()])


def all_spans(text: str, grammars: list[tuple[Automaton, float]]) -> list[tuple[int, int, str]]:
    base = base_spans(text)
    out = list(base)
    for m in CANDIDATE.finditer(text):
        if not DIGIT.search(m[0]):
            continue
        value, start = m[0], m.start()
        if any(s < m.end() and start < e for s, e, _ in base):
            continue
        if any(a.score(value) >= least for a, least in grammars):
            out.append((start, m.end(), "format"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    grammars = fit(docs, id_col, text_col)

    @F.pandas_udf("struct<n_assign long, n_access long, n_hex long, base_sha256 string, spans string>")
    def find(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in texts:
            rows = []
            for t in s:
                spans = all_spans(t or "", grammars)
                base = [x for x in spans if x[2] != "format"]
                n = Counter(k for *_, k in base)
                rows.append((n["assign"], n["access"], n["hex"],
                             hashlib.sha256(written(base).encode()).hexdigest(), written(spans)))
            yield pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    out = docs.select(F.col(id_col).alias("id"), find(F.col(text_col)).alias("f"))
    return out.select(F.col("id").alias(id_col), "f.*")
