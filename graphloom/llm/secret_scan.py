"""Secret scan by grammar inference.

Values that three fixed patterns find (BASE kinds: assign, access, hex) are
labelled credentials. From a bounded sample of them, ``SAMPLE`` different ones of each
kind, of at most ``LONGEST`` characters, one probabilistic automaton for each kind is inferred:

* A value is read as symbols. A letter or digit is read as the value's alphabet (digits, small
  hex, capitals and digits, ...: ALPHABETS), a mark as itself. Where a character stands in
  one place far more often than its alphabet explains (Hoeffding bound), as
  in a fixed prefix, it is read as itself too.
* The values form a prefix tree, and states whose ending and branching rates,
  and those of all states that follow, are statistically compatible (Hoeffding bound,
  ``ALPHA``) are merged in breadth-first order. States of fewer than ``FEWEST`` values say too
  little to be merged, and stay. So lengths, prefixes and the places of marks survive.

Candidates are all runs of credential characters of the whole corpus that aren't
ordinary words, of 6 characters or more, and the parts of such runs between ``.``, ``/`` and
``=``; they overlap. A candidate is a secret (a span of kind ``format``) if it is as
likely under an automaton as all but a twentieth (``TAIL``) of that kind's values under
automata that didn't learn from them (five folds, or one for each value if there are
fewer), and if that likelihood isn't below a tenth of the rate (``ODDS``) of its alphabet and
length among all candidates. The fixed patterns' spans always stay.

Text is read once: spans and candidates go to a narrow table, from which the
sample is drawn and the candidates are scored. The automata travel with the tasks.

Defined cases: a null or empty text has no spans, counts of 0 and the checksum
of the empty string; a kind with one labelled value accepts values of the same alphabet,
marks and length; without labelled values no automaton exists and the
fixed spans are all; repeated rows are scanned each; an empty table gives an
empty result; other columns are kept by ``redact_stage`` and ignored else. A word of
at most 20 letters that has no capital but the first is ordinary, and so are such words
joined by single hyphens or dots: a credential of that form is found by the fixed patterns only.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SAMPLE, ALPHA, TAIL, FEWEST, LONGEST = 1500, 0.05, 0.05, 10, 256
#: A candidate may be so much less likely, in logarithms, than its alphabet and length are frequent: ten times.
ODDS = math.log(10)

# Kinds and patterns of the contract.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: The kind of spans that the automata add.
ADDED = "format"

#: A run of credential characters that isn't ordinary words.
_RUN = r"[A-Za-z0-9+/_=-]"
_ORDINARY = r"[A-Za-z]?[a-z]{0,19}+"
CANDIDATE = re.compile(rf"(?<!{_RUN})(?!{_ORDINARY}(?:[-.]{_ORDINARY})*+(?!{_RUN}))[-=]*+({_RUN}+(?:\.{_RUN}+)*)")
_CUT, _PART = re.compile("[./=]"), re.compile("[^./=]{6,}")
_IS_ORDINARY = re.compile(rf"{_ORDINARY}(?:-{_ORDINARY})*")
_WORDS = re.compile(r"password|passwd|secret|token|api_?key", re.I | re.A)


def base_spans(text: str) -> list[tuple[str, int, int, int]]:
    """kind, start, end and the start of the value, of all that the fixed patterns find."""
    out = []
    if _WORDS.search(text):
        out += [("assign", m.start(), m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", m.start(), m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def candidates_of(text: str, base: list[tuple[str, int, int, int]]) -> list[tuple[int, int]]:
    """Start and end of each candidate that no fixed span touches; of those that overlap the longest comes first."""
    starts, stops = [], []  # the fixed spans, those that touch put together
    for _, i, j, _ in base:
        if stops and i <= stops[-1]:
            stops[-1] = max(stops[-1], j)
        else:
            starts.append(i), stops.append(j)

    def free(i: int, j: int) -> bool:
        k = bisect_left(starts, j) - 1
        return k < 0 or stops[k] <= i

    out = []
    for m in CANDIDATE.finditer(text):
        i, j = m.span(1)
        if j - i < 6:
            continue
        if free(i, j):
            out.append((i, j))
        if _CUT.search(m[1]):
            out += [
                (i + p.start(), i + p.end()) for p in _PART.finditer(m[1])
                if p.end() - p.start() < j - i and not _IS_ORDINARY.fullmatch(p[0]) and free(i + p.start(), i + p.end())
            ]
    return out


# Alphabets: symbol, what it has beside marks, and number of characters.
ALPHABETS = {
    "d": ("digits", 10), "x": ("digits and a-f", 16), "X": ("digits and A-F", 16), "l": ("small letters", 26), "U": ("capitals", 26),
    "n": ("small letters and digits", 36), "N": ("capitals and digits", 36), "m": ("letters", 52), "w": ("letters and digits", 62), "b": ("letters, digits, + and /", 64), "u": ("letters, digits, - and _", 64),
}
_SMALL, _OTHER, _CAPITAL, _RARE, _DIGIT, _SIGN = (re.compile(p) for p in ("[a-f]", "[g-z]", "[A-F]", "[G-Z]", "[0-9]", "[+/]"))


def alphabet(value: str) -> str:
    """Symbol of the least alphabet that holds a value's letters and digits."""
    if _SIGN.search(value):
        return "b"
    digit = bool(_DIGIT.search(value))
    small, other, capital, rare = (bool(p.search(value)) for p in (_SMALL, _OTHER, _CAPITAL, _RARE))
    if (small or other) and (capital or rare):
        return "w" if digit else "m"
    if small or other:
        return "l" if not digit else "n" if other else "x"
    if capital or rare:
        return "U" if not digit else "N" if rare else "X"
    return "d"


def alphabet_column(value: Column) -> Column:
    """The same as a column."""
    has = lambda p: value.rlike(p)
    digit, small, capital = has("[0-9]"), has("[a-z]"), has("[A-Z]")
    return (
        F.when(has("[+/]"), "b").when(small & capital, F.when(digit, "w").otherwise("m"))
        .when(small, F.when(~digit, "l").when(has("[g-z]"), "n").otherwise("x"))
        .when(capital, F.when(~digit, "U").when(has("[G-Z]"), "N").otherwise("X")).otherwise("d")
    )


_BODY = {"b": re.compile("[A-Za-z0-9+/]"), "u": re.compile("[A-Za-z0-9_-]"), "w": re.compile("[A-Za-z0-9]")}
_DASH = re.compile("[-_]")


def _marks(value: str) -> str:
    return _BODY["b"].sub("a", value)


def symbols(value: str, alpha: str) -> str:
    """The value with letters and digits (and + and / in that alphabet) replaced by its alphabet's symbol."""
    return _BODY.get(alpha, _BODY["w"]).sub(alpha, value)


def readings(values: list[str]) -> list[str]:
    """Symbols of each value. Where the places of - and _ differ from value to value of one alphabet and length, they are characters like others."""
    places = Counter(map(_marks, values))
    of = [(alphabet(v), len(v)) for v in values]
    every = Counter(k for k, v in zip(of, values) if _DASH.search(v))
    lone = Counter(k for k, v in zip(of, values) if _DASH.search(v) and places[_marks(v)] == 1)
    loose = {k for k, n in lone.items() if n >= 3 and 2 * n > every[k]}
    return [symbols(v, "u" if k in loose and _DASH.search(v) and places[_marks(v)] == 1 else k[0]) for k, v in zip(of, values)]


class Automaton:
    """A probabilistic automaton, inferred from different values by state merging. A branch is a symbol, or "=" and a character that stands for itself."""

    def __init__(self, values, alpha: float = ALPHA):
        self.next: list[dict[str, int]] = []
        self.seen: list[dict[str, int]] = []  # times each branch was taken
        self.ends: list[int] = []
        self.total: list[int] = []
        self.alpha = alpha
        self._grow(sorted(set(values)))
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge_all()

    def _state(self, total: int) -> int:
        for x, v in ((self.next, {}), (self.seen, {}), (self.ends, 0), (self.total, total)):
            x.append(v)
        return len(self.next) - 1

    def _grow(self, values: list[str]) -> None:
        """The prefix tree."""
        read = readings(values)
        todo = [(self._state(len(values)), 0, list(range(len(values))))]
        while todo:
            at, depth, here = todo.pop()
            by: dict[str, list[int]] = {}
            for k in here:
                if len(values[k]) == depth:
                    self.ends[at] += 1
                else:
                    by.setdefault(read[k][depth], []).append(k)
            branches: dict[str, list[int]] = {}
            for symbol, some in by.items():
                size = ALPHABETS[symbol][1] if symbol in ALPHABETS else 1
                usual = 1 / size + math.sqrt(math.log(size / self.alpha) / (2 * len(some)))
                chars = Counter(values[k][depth] for k in some)
                fixed = {c for c, n in chars.items() if size > 1 and n / len(some) > usual}
                for k in some:
                    c = values[k][depth]
                    branches.setdefault("=" + c if c in fixed else symbol, []).append(k)
            for branch, mine in branches.items():
                self.seen[at][branch] = len(mine)
                self.next[at][branch] = self._state(len(mine))
                todo.append((self.next[at][branch], depth + 1, mine))

    def _far(self, a: int, n: int, b: int, m: int) -> bool:
        return abs(a / n - b / m) > self.bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def _compatible(self, p: int, q: int) -> bool:
        todo, judged = [(p, q)], set()
        while todo:
            a, b = todo.pop()
            n, m = self.total[a], self.total[b]
            if (a, b) in judged or not n or not m:
                continue
            judged.add((a, b))
            if self._far(self.ends[a], n, self.ends[b], m):
                return False
            for c in self.seen[a].keys() | self.seen[b].keys():
                if self._far(self.seen[a].get(c, 0), n, self.seen[b].get(c, 0), m):
                    return False
                if c in self.next[a] and c in self.next[b]:
                    todo.append((self.next[a][c], self.next[b][c]))
        return True

    def _fold(self, p: int, q: int) -> None:
        """Add the subtree below q to the state p."""
        todo = [(p, q)]
        while todo:
            a, b = todo.pop()
            self.ends[a] += self.ends[b]
            self.total[a] += self.total[b]
            for c, n in self.seen[b].items():
                self.seen[a][c] = self.seen[a].get(c, 0) + n
                if c in self.next[a]:
                    todo.append((self.next[a][c], self.next[b][c]))
                else:
                    self.next[a][c] = self.next[b][c]

    def _merge_all(self) -> None:
        red, known = [0], {0}
        blue = deque((0, c) for c in sorted(self.next[0]))
        while blue:
            p, c = blue.popleft()
            q = self.next[p][c]
            if q in known or self.total[q] < FEWEST:
                continue
            for r in red:
                if self._compatible(r, q):
                    self.next[p][c] = r
                    self._fold(r, q)
                    # What the fold hung below a kept state is still to be judged.
                    blue.extend((r, x) for x in sorted(self.next[r]) if self.next[r][x] not in known)
                    break
            else:
                known.add(q)
                red.append(q)
                blue.extend((q, x) for x in sorted(self.next[q]))
        self.states = len(red)

    def _likelihood(self, value: str, read: str) -> float:
        """Log-likelihood of the best path: a character may stand for itself or for its alphabet."""
        paths = {0: 0.0}
        for k, c in enumerate(value):
            new: dict[int, float] = {}
            for at, total in paths.items():
                n, after = self.total[at] + 0.02, self.next[at]
                for branch in ("=" + c, read[k]):
                    if branch in after:
                        x = total + math.log((self.seen[at][branch] + 0.01) / n)
                        if x > new.get(after[branch], -math.inf):
                            new[after[branch]] = x
            if not new:
                return max(t + math.log(0.01 / (self.total[at] + 0.02)) for at, t in paths.items()) + (len(value) - k) * math.log(0.05)
            paths = new
        return max(t + math.log((self.ends[at] + 0.01) / (self.total[at] + 0.02)) for at, t in paths.items())

    def score(self, value: str, alpha: str | None = None) -> float:
        """Log-likelihood of a value; what no labelled value had costs much, and so does each character after it."""
        best = self._likelihood(value, symbols(value, alpha or alphabet(value)))
        return max(best, self._likelihood(value, symbols(value, "u"))) if _DASH.search(value) else best


class Formats:
    """Automata of the kinds with their thresholds, and the rates of alphabets and lengths among all candidates."""

    def __init__(self, values: dict[str, list[str]], rates: dict[tuple[str, int], int]):
        total = sum(rates.values()) + 1
        self.rates = {k: math.log((n + 0.5) / total) for k, n in rates.items()}
        self.rare = math.log(0.5 / total)
        self.automata, self.least, self.held_out = {}, {}, {}
        for kind, found in values.items():
            found = sorted({v for v in found if 6 <= len(v) <= LONGEST}, key=lambda v: hashlib.md5(v.encode()).digest())
            if not found:
                continue
            self.automata[kind] = Automaton(found)
            folds = min(5, len(found))
            scores = []  # of values, under automata that haven't seen them
            for k in range(folds):
                a = Automaton([v for i, v in enumerate(found) if i % folds != k]) if folds > 1 else self.automata[kind]
                scores += [(a.score(v), self.usual(v)) for v in found[k::folds]]
            ranked = sorted(s for s, _ in scores)
            # Half a unit allows for the smaller samples of the folds.
            self.least[kind] = ranked[int(TAIL * len(ranked))] - 0.5
            #: Share of the values that would be found by automata that haven't seen them.
            self.held_out[kind] = sum(s >= self.least[kind] and s >= u - ODDS for s, u in scores) / len(scores)

    def usual(self, value: str, alpha: str | None = None) -> float:
        """Log-rate of the value's alphabet and length among all candidates."""
        return self.rates.get((alpha or alphabet(value), min(len(value), LONGEST)), self.rare)

    def fits(self, value: str) -> bool:
        alpha = alphabet(value)
        usual = self.usual(value, alpha) - ODDS
        return any((x := a.score(value, alpha)) >= self.least[k] and x >= usual for k, a in self.automata.items())

    def chosen(self, found: list[tuple[int, int, str]]) -> list[int]:
        """Which of candidates (start, end, value), in text order, are secrets; none overlaps one before it."""
        out, at = [], 0
        for k, (i, j, value) in enumerate(found):
            if i >= at and self.fits(value):
                out.append(k)
                at = j
        return out


SPAN = "struct<kind:string,start:long,stop:long,value:string>"


def found(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans (of the fixed patterns) and candidates that no such span touches, of each row."""
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("value", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans, others = [], []
            for text in b.column(1).to_pylist():
                text = text or ""
                base = base_spans(text)
                spans.append([{"kind": k, "start": i, "stop": j, "value": text[v:j]} for k, i, j, v in base])
                others.append([{"kind": ADDED, "start": i, "stop": j, "value": text[i:j]} for i, j in candidates_of(text, base)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, pa.list_(span)), pa.array(others, pa.list_(span))], ["doc_id", "spans", "candidates"])

    rows = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text"))
    return common.map_arrow(rows, run, f"doc_id long, spans array<{SPAN}>, candidates array<{SPAN}>")


def infer(table: DataFrame, sample: int = SAMPLE) -> Formats:
    """Formats from found() rows. The driver gets at most `sample` values of each kind, those with the least hashes, and a count for each alphabet and length."""
    values = table.select(F.explode("spans").alias("s")).select("s.kind", "s.value").where(F.length("value").between(6, LONGEST))
    labelled = {}
    for kind in KINDS:
        rows = values.where(F.col("kind") == kind).select("value").distinct().orderBy(F.xxhash64("value"), "value").limit(sample)
        labelled[kind] = [r["value"] for r in rows.collect()]
    rates = table.select(F.explode("candidates.value").alias("v")).groupBy(alphabet_column(F.col("v")).alias("a"), F.least(F.length("v"), F.lit(LONGEST)).alias("n"))
    return Formats(labelled, {(r["a"], r["n"]): r["count"] for r in rates.count().collect()})


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """doc_id, spans and added (spans of the automata) of each row."""
    table = common.materialize(found(df, id_col, text_col))
    formats = infer(table, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = []
            for row in b.column(2).to_pylist():
                kept.append([row[k] for k in formats.chosen([(c["start"], c["stop"], c["value"]) for c in row])])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(kept, b.schema.field(2).type)], ["doc_id", "spans", "added"])

    return common.map_arrow(table, run, f"doc_id long, spans array<{SPAN}>, added array<{SPAN}>")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(common.documents(spark, sf_dir).select("doc_id", "text"))
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    named = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    # Fixed spans are in order; the added kind's letters come between theirs, but it never starts where one of theirs does.
    every = F.array_sort(F.concat("spans", "added"), lambda a, b: (a["start"] - b["start"]).cast("int"))
    every = F.when(F.size("added") > 0, every).otherwise(F.col("spans"))
    return out.select("doc_id", *[n(k) for k in KINDS], F.sha2(named("spans"), 256).alias("base_sha256"), named(every).alias("spans"))


MASK = "[SECRET]"


def redact(text: str, formats: Formats) -> str:
    """text with each secret's value replaced; values that overlap are replaced together."""
    base = base_spans(text)
    found = candidates_of(text, base)
    added = formats.chosen([(i, j, text[i:j]) for i, j in found])
    spans = [(v, j) for _, _, j, v in base] + [found[k] for k in added]
    if not spans:
        return text
    out, at = [], 0
    for i, j in sorted(spans):
        if i >= at:
            out += [text[at:i], MASK]
        at = max(at, j)
    return "".join(out) + text[at:]


def redact_stage(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """docs in the same columns, with the secrets in text replaced and n_chars counted anew where a text has changed."""
    table = common.materialize(found(docs.select("doc_id", "text")).where("size(spans) > 0 OR size(candidates) > 0"))
    formats = infer(table, sample)
    names = docs.columns
    at, chars = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            old = b.column(at).to_pylist()
            new = [t if t is None else redact(t, formats) for t in old]
            cols = list(b.columns)
            cols[at] = pa.array(new, b.schema.field(at).type)
            if chars is not None:
                counts = b.column(chars).to_pylist()
                counts = [n if x == y else len(y) for n, x, y in zip(counts, old, new)]
                cols[chars] = pa.array(counts, b.schema.field(chars).type)
            yield pa.RecordBatch.from_arrays(cols, schema=b.schema)

    return common.map_arrow(docs, run, docs.schema)
