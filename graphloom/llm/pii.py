"""Personal data by gradient-boosted candidates (DataFrame functions only).

Generators with high recall propose candidate spans: the fixed patterns of the
four kinds (email, ip, card, phone), before their checks; looser forms of each kind
(written-out "at" and dots, numbers without a plus sign, other separators);
and the parts of matches that fail their checks (such a match may have swallowed
neighbouring digits); these overlap. A loose candidate or part must pass its kind's
check (checksum and length, octets, length).

Boosted trees then judge a candidate by format (separators, brackets, groups of
digits) and context (words before it that tell of personal data or of other numbers,
what it touches, other numbers beside it). They are trained on weak labels that these features do not
contain: whether a fixed match of the kind passes the check. Checksum, length and octets, which
define the labels, are withheld. An e-mail address's label is whether its last part is a name of two letters or more.
So trees learn in which forms and contexts matches turn out to be true ones, and loose candidates,
all of which pass the check, are kept where that is so.

Features are small whole numbers, so all candidates of the corpus are counted by
feature cell (their number is bounded, whatever the corpus). The trees are fitted to the cells
of three quarters of the documents (by a hash of doc_id) and become one column
expression. Each family's threshold is calibrated on the cells of the others: the lowest score from which on the
share of true candidates is ``PRECISION`` or more; a family without such documents is calibrated on all.
Loose candidates above it that touch no fixed span are added. Where
some overlap, a sweep by start holds one and gives it up for a better one (by score, then length).

Positions come from splitting a text at its matches: pieces between and of
matches alternate, and running sums of their lengths (code points) are the places. Sums, overlaps and the
sweep are made in blocks, in time proportional to the matches. The
mark that splits is U+0001; one that stands in a text counts as U+0002,
which no pattern matches either.

Defined cases: a null or empty text has no spans, counts of 0 and the checksum
of the empty string; without labelled candidates nothing is added; repeated
rows are scanned each; an empty table gives an empty result; other columns are
never looked at.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")
PRECISION, ROUNDS, RATE = 0.9, 25, 0.4
#: Elements of a block of a running sum.
BLOCK = 64
#: One document in so many calibrates.
HELD_OUT = 4

# Patterns of the contract. Looking back and possessive repeats keep Java's matcher linear and
# change no match: a match that starts inside a run of its first class could start where the run does.
_LOCAL, _HOST = r"[A-Za-z0-9._%+-]", r"[A-Za-z0-9-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must contain for a pattern to be worth trying.
HINTS = {
    "email": "@",
    "ip": r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]",
    "card": r"[0-9](?:[ -]?[0-9]){11}",
    "phone": r"\+[0-9]",
}
#: Looser forms: family whose trees and threshold judge them, pattern, hint.
LOOSE = {
    "email_like": ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[(] ?(?:at|AT) ?[\])] ?[A-Za-z0-9-]++(?:(?:\.| ?[\[(] ?(?:dot|DOT) ?[\])] ?)[A-Za-z0-9-]++)+", r"[\[(] ?(?:at|AT) ?[\])]"),
    "ip_like": ("ip", r"(?<![0-9.])[0-9]{1,3}(?: ?[\[(] ?(?:\.|dot|DOT) ?[\])] ?[0-9]{1,3}){3}(?![0-9])", r"[0-9] ?[\[(] ?(?:\.|dot|DOT) ?[\])]"),
    "card_like": ("card", r"(?<![0-9])(?:[0-9]{4}(?:[ ._/\u00A0-]{1,2}[0-9]{4}){2}[ ._/\u00A0-]{1,2}[0-9]{1,7}|[0-9]{4}[ ._/\u00A0-]{1,2}[0-9]{6}[ ._/\u00A0-]{1,2}[0-9]{5})(?![0-9])", r"[0-9]{4}[ ._/\u00A0-]{1,2}[0-9]{4}"),
    "phone_like": ("phone", r"(?<![0-9A-Za-z+.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z.-])", r"[0-9]{3}[ .-][0-9]{4}"),
}
#: Parts of fixed matches that fail their check: a match may have swallowed its neighbours' digits.
PARTS = {"card": "card_like", "ip": "ip_like", "phone": "phone_like"}
#: Runs of more numbers than an address has; the fixed pattern takes four at a time.
CHAIN = (r"(?<![0-9])[0-9]++(?:\.[0-9]++){4,}+", r"[0-9](?:\.[0-9]+){4}")
#: Most code points of a telephone number, and digits of a card.
PHONE_SIZE, CARD_DIGITS = 40, 19
FAMILIES = KINDS

# Words that announce each kind of personal data, in the order of KINDS, and words that announce other numbers.
_TELLING = [r"mail|contact|write|reach", r"ip|host|addr|server|login", r"card|visa|pay|credit", r"phone|tel|call|fax|mobile"]
_TELLING = [rf"(?i)(?:{words})[^A-Za-z]{{0,12}}$" for words in _TELLING]
_DENYING = r"(?i)(?:order|invoice|ref|serial|sku|isbn|version|release|build|item|id|no|number|total|sum|page|section|date)[^A-Za-z]{0,4}$"

FEATURES = ("family", "seps", "plus", "brackets", "groups", "longest", "dots", "telling", "denying", "before", "after", "beside")


def _running(a: Column, kind: str, zero: Column, op, levels: int = 2) -> Column:
    """Of each element of an array, op of all elements before it. Blocks keep copies of growing arrays short."""

    def short(x):
        return F.aggregate(
            x,
            F.struct(zero.alias("at"), F.array().cast(f"array<{kind}>").alias("all")),
            lambda acc, v: F.struct(op(acc["at"], v).alias("at"), F.array_append(acc["all"], acc["at"]).alias("all")),
        )["all"]

    if not levels:
        return short(a)

    def joined(blocks):
        heads = _running(F.transform(blocks, lambda x: F.aggregate(x, zero, op)), kind, zero, op, levels - 1)
        return common.let(heads, lambda h: F.flatten(F.transform(blocks, lambda x, k: F.transform(short(x), lambda v: op(F.get(h, k), v)))))

    return common.let(a, lambda x: common.let(_blocks(x), joined))


def _blocks(a: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(a) - 1, F.lit(0)) / BLOCK).cast("int")), lambda k: F.slice(a, k * BLOCK + 1, BLOCK))


def _starts(pieces: Column) -> Column:
    """Where each piece of a text starts."""
    return _running(F.transform(pieces, lambda x: F.length(x).cast("long")), "bigint", F.lit(0).cast("long"), lambda x, y: x + y)


def _matches(text: Column, kind: str, pattern: str, hint: str) -> Column:
    """kind, start, stop, value, before and after of each match."""
    marked = F.regexp_replace(text, pattern, "\u0001$0\u0001")
    pieces = F.split(marked, "\u0001")

    def spans(p):
        return common.let(
            _starts(p),
            lambda s: F.transform(
                F.filter(F.sequence(F.lit(0), F.size(p) - 1), lambda i: i % 2 == 1),
                lambda i: F.struct(
                    F.lit(kind).alias("kind"),
                    F.get(s, i).alias("start"),
                    (F.get(s, i) + F.length(F.get(p, i))).alias("stop"),
                    F.get(p, i).alias("value"),
                    F.right(F.get(p, i - 1), F.lit(24)).alias("before"),
                    F.left(F.get(p, i + 1), F.lit(8)).alias("after"),
                ),
            ),
        )

    has = F.contains(text, F.lit(hint)) if hint == "@" else text.rlike(hint)
    return F.when(has, common.let(pieces, spans)).otherwise(F.array().cast(SPANS))


SPANS = "array<struct<kind:string,start:bigint,stop:bigint,value:string,before:string,after:string>>"


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the checksum."""
    n = F.length(digits)
    total = F.aggregate(
        F.sequence(F.lit(1), n),
        F.lit(0),
        lambda acc, i: acc
        + common.let(
            F.substring(digits, n - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1),
            lambda x: F.when(x > 9, x - 9).otherwise(x),
        ),
    )
    return F.when((n >= 12) & (n <= 19), total % 10 == 0).otherwise(F.lit(False))


def _octets(v: Column) -> Column:
    return F.forall(
        F.split(v, r"\."),
        lambda p: common.let(
            F.regexp_replace(p, "^0+(?=[0-9])", ""),
            lambda x: (F.length(x) <= 3) & F.coalesce(x.try_cast("int") <= 255, F.lit(False)),
        ),
    )


def _valid(s: Column) -> Column:
    """The check of a candidate's kind; a loose form's or part's is that of its family."""
    n = F.length(_digits(s["value"]))
    return (
        F.when(s["kind"].isin("email", "email_like"), F.lit(True))
        .when(s["kind"].isin("ip", "ip_like"), _octets(F.regexp_replace(F.regexp_replace(s["value"], "[^0-9]+", "."), r"^\.|\.$", "")))
        .when(s["kind"].isin("card", "card_like"), common.let(_digits(s["value"]), _luhn))
        .when(s["kind"].isin("phone", "phone_like"), (n >= 9) & (n <= 15))
        .otherwise(F.lit(False))
    )


def _label(s: Column) -> Column:
    """The weak label of a fixed match; no feature has what it is made of. Numbers that can't be a card's for their length have none."""
    number = F.length(_digits(s["value"])).between(12, CARD_DIGITS)
    return F.when(s["kind"] == "email", s["value"].rlike(r"\.[A-Za-z]{2,}$")).when((s["kind"] != "card") | number, _valid(s))


def _phone_parts(s: Column) -> Column:
    """Beginnings of the match s that end where its numbers do."""
    head = F.left(s["value"], F.lit(PHONE_SIZE + 1))
    digit = lambda v, i: F.substring(v, i, F.lit(1)).rlike("[0-9]")

    def of(v):
        ends = F.filter(F.sequence(F.lit(9), F.greatest(F.lit(9), F.least(F.lit(PHONE_SIZE), F.length(v)))), lambda j: digit(v, j) & ~digit(v, j + 1))
        return F.transform(
            ends,
            lambda j: F.struct(
                F.lit(PARTS["phone"]).alias("kind"), s["start"].alias("start"), (s["start"] + j).alias("stop"), F.left(v, j).alias("value"), s["before"].alias("before"),
                F.when(j < F.length(v), F.substring(v, j + 1, F.lit(8))).otherwise(s["after"]).alias("after"),
            ),
        )

    return common.let(head, of)


def _number_parts(s: Column, kind: str) -> Column:
    """Runs of the numbers of the match s: four for an address, up to CARD_DIGITS digits for a card. One character is between two numbers."""
    mark = "." if kind == "ip" else " "

    def of(numbers):
        def at_each(starts):
            def run(i, k):
                some = F.slice(numbers, i + 1, k)
                at = s["start"] + F.get(starts, i) + i
                value = F.array_join(some, mark)
                near = F.when(F.get(starts, i) + i < 24, F.left(s["value"], (F.get(starts, i) + i).cast("int"))).otherwise(F.lit("0" * 24))
                return F.struct(
                    F.lit(PARTS[kind]).alias("kind"), at.alias("start"), (at + F.length(value)).alias("stop"), value.alias("value"),
                    F.right(F.concat(F.when(F.get(starts, i) + i < 24, s["before"]).otherwise(F.lit("")), near), F.lit(24)).alias("before"),
                    F.when(i + k < F.size(numbers), F.concat(F.lit(mark), F.left(F.get(numbers, i + k), F.lit(7)))).otherwise(s["after"]).alias("after"),
                )

            counts = F.array(F.lit(4)) if kind == "ip" else F.sequence(F.lit(1), F.lit(CARD_DIGITS))
            fits = lambda p: p["value"].rlike(r"^[0-9]+(?:\.[0-9]+){3}$") if kind == "ip" else F.length(_digits(p["value"])).between(12, CARD_DIGITS)
            every = F.sequence(F.lit(0), F.size(numbers) - 1)
            return F.flatten(F.transform(every, lambda i: F.filter(F.transform(F.filter(counts, lambda k: i + k <= F.size(numbers)), lambda k: run(i, k)), fits)))

        return common.let(_starts(numbers), at_each)

    return common.let(F.split(s["value"], "[^0-9]"), of)


def _all_parts(spans: Column, chains: Column) -> Column:
    none = F.array().cast(SPANS)
    failed = lambda kind, least: F.filter(spans, lambda s: (s["kind"] == kind) & (F.length(s["value"]) > least) & ~_valid(s))
    within = lambda a, f: F.flatten(F.transform(a, f))
    every = [within(failed("card", 12), lambda s: _number_parts(s, "card")), within(failed("phone", 9), _phone_parts), within(chains, lambda s: _number_parts(s, "ip"))]
    return F.concat(*[F.coalesce(x, none) for x in every])


def _features(s: Column) -> Column:
    """Small whole numbers that describe a candidate; none tells its check."""
    v = s["value"]
    family = F.coalesce(*[F.when(s["kind"] == k, F.lit(FAMILIES.index(f))) for k, f in _family().items()])
    number = family != FAMILIES.index("email")
    count = lambda chars: F.length(F.regexp_replace(v, f"[^{chars}]", ""))
    touch = lambda c, end: F.when(c.rlike(f"[A-Za-z]{end}" if end else "^[A-Za-z]"), 1).when(c.rlike(f"[0-9]{end}" if end else "^[0-9]"), 2).otherwise(0)
    groups = F.split(v, "[^0-9]+")
    return F.struct(
        family.alias("family"),
        F.least(F.lit(4), count(" -")).alias("seps"),
        v.startswith("+").cast("int").alias("plus"),
        F.least(F.lit(2), count("()")).alias("brackets"),
        # The groups of a card or an address are its length or its octets.
        F.when(family == FAMILIES.index("phone"), F.least(F.lit(6), F.size(F.array_remove(groups, "")))).otherwise(0).alias("groups"),
        F.when(family == FAMILIES.index("phone"), F.least(F.lit(8), F.array_max(F.transform(groups, lambda g: F.length(g))))).otherwise(0).alias("longest"),
        F.when(number, 0).otherwise(F.least(F.lit(4), count("."))).alias("dots"),
        F.coalesce(*[F.when(s["before"].rlike(p), k + 1) for k, p in enumerate(_TELLING)], F.lit(0)).alias("telling"),
        s["before"].rlike(_DENYING).cast("int").alias("denying"),
        touch(s["before"], "$").alias("before"),
        touch(s["after"], "").alias("after"),
        (s["before"].rlike("[0-9][ .,:/-]{1,2}$") | s["after"].rlike("^[ .,:/-]{1,2}[0-9]")).cast("int").alias("beside"),
    )


def _family() -> dict[str, str]:
    return {k: k for k in KINDS} | {k: f for k, (f, _, _) in LOOSE.items()} | {v: k for k, v in PARTS.items()}


def candidates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and cands of each row: the candidates with their features and whether a fixed check holds."""
    text = F.replace(common.whole_text(df, text_col), F.lit("\u0001"), F.lit("\u0002"))
    rows = df.select(df[id_col].cast("long").alias("doc_id"), text.alias("t"))
    t = F.col("t")
    every = [_matches(t, k, PATTERNS[k], HINTS[k]) for k in KINDS] + [_matches(t, k, p, h) for k, (_, p, h) in LOOSE.items()]
    rows = rows.select("doc_id", F.concat(*every).alias("spans"), _matches(t, "ip", *CHAIN).alias("chains"))
    # Shorter numbers fail every check of a card and hold no parts.
    rows = rows.select("doc_id", F.filter("spans", lambda s: (s["kind"] != "card") | (F.length(s["value"]) >= 12)).alias("spans"), "chains")
    rows = rows.select("doc_id", F.concat("spans", _all_parts(F.col("spans"), F.col("chains"))).alias("spans"))
    return rows.select(
        "doc_id",
        F.transform(
            "spans",
            lambda s: F.struct(
                s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"),
                s["kind"].isin(*KINDS).alias("fixed"), _valid(s).alias("valid"), _label(s).alias("label"), _features(s).alias("x"),
            ),
        ).alias("cands"),
    )


class Boosted:
    """Trees of two splits, boosted on counted cells under the logistic loss."""

    def __init__(self, x: np.ndarray, n: np.ndarray, true: np.ndarray, rounds: int = ROUNDS, rate: float = RATE):
        self.trees: list[tuple] = []
        share = (true.sum() + 0.5) / (n.sum() + 1)
        self.base = math.log(share / (1 - share))
        z = np.full(len(n), self.base)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-z))
            g, h = true - n * p, n * p * (1 - p)
            root = self._split(x, g, h, np.ones(len(n), bool))
            if root is None:
                break
            f, cut = root
            sides, leaves = [x[:, f] <= cut, x[:, f] > cut], []
            for side in sides:
                inner = self._split(x, g, h, side)
                parts = [side] if inner is None else [side & (x[:, inner[0]] <= inner[1]), side & (x[:, inner[0]] > inner[1])]
                values = [rate * float(g[k].sum() / (h[k].sum() + 1.0)) for k in parts]
                for k, v in zip(parts, values):
                    z[k] += v
                leaves.append((inner, values))
            self.trees.append((f, cut, leaves))

    def of(self, x: np.ndarray) -> np.ndarray:
        """Scores of rows of features, as column() gives them."""
        z = np.full(len(x), self.base)
        for f, cut, leaves in self.trees:
            side = (x[:, f] > cut).astype(int)
            for which, (inner, values) in enumerate(leaves):
                here = side == which
                z[here] += values[0] if inner is None else np.where(x[here, inner[0]] <= inner[1], values[0], values[1])
        return z

    @staticmethod
    def _split(x, g, h, where):
        """Feature and cut with the greatest gain, or None."""
        best, at = 1e-6, None
        whole = g[where].sum() ** 2 / (h[where].sum() + 1.0)
        for f in range(x.shape[1]):
            for cut in np.unique(x[where, f])[:-1]:
                left = where & (x[:, f] <= cut)
                right = where & ~left
                gain = g[left].sum() ** 2 / (h[left].sum() + 1.0) + g[right].sum() ** 2 / (h[right].sum() + 1.0) - whole
                if gain > best:
                    best, at = gain, (f, int(cut))
        return at

    def column(self, x: Column) -> Column:
        """The score of a struct of features."""
        total = F.lit(self.base)
        for f, cut, leaves in self.trees:
            sides = []
            for inner, values in leaves:
                one = F.lit(values[0])
                sides.append(one if inner is None else F.when(x[FEATURES[inner[0]]] <= inner[1], one).otherwise(F.lit(values[1])))
            total = total + F.when(x[FEATURES[f]] <= cut, sides[0]).otherwise(sides[1])
        return total


def fit(table: DataFrame) -> tuple[Boosted, dict[str, float]] | None:
    """Trees and each family's threshold, from all fixed candidates of candidates() rows, counted by cell and side."""
    aside = (F.pmod(F.xxhash64("doc_id"), F.lit(HELD_OUT)) == 0).alias("aside")
    c = table.select(aside, F.explode("cands").alias("c")).where("c.fixed AND c.label IS NOT NULL").select("aside", "c.x.*", F.col("c.label").cast("long").alias("label"))
    cells = c.groupBy("aside", *FEATURES).agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("true")).collect()
    if not cells:
        return None
    cells.sort(key=lambda r: (r["aside"], *(r[f] for f in FEATURES)))
    side = np.array([r["aside"] for r in cells])
    if side.all():  # nothing to learn from but documents set aside
        side[:] = False
    x = np.array([[r[f] for f in FEATURES] for r in cells])
    n, true = (np.array([r[k] for r in cells], float) for k in ("n", "true"))
    model = Boosted(x[~side], n[~side], true[~side])
    scores, least = model.of(x), {}
    for k, family in enumerate(FAMILIES):
        mine = np.flatnonzero((x[:, 0] == k) & side)
        if not len(mine):
            mine = np.flatnonzero(x[:, 0] == k)
        order = mine[np.argsort(-scores[mine], kind="stable")]
        share = np.cumsum(true[order]) / np.cumsum(n[order]) if len(order) else np.array([])
        # Cells of one score pass together.
        last = np.append(scores[order][1:] != scores[order][:-1], True) if len(order) else np.array([], bool)
        good = np.flatnonzero((share >= PRECISION) & last)
        if len(good):
            least[family] = float(scores[order[good[-1]]])
    return model, least


SPAN = "struct<cost:double,less:bigint,start:bigint,stop:bigint,kind:string>"


def _apart(some: Column, base: Column) -> Column:
    """Those of some (SPANs) that touch no span of base, by start: a sweep over both."""
    most = F.lit((1 << 62)).cast("long")
    marked = F.concat(
        F.transform(base, lambda s: F.struct(s["start"].alias("start"), F.lit(0).alias("rank"), s["stop"].alias("stop"), F.lit(None).cast(SPAN).alias("span"))),
        F.transform(some, lambda s: F.struct(s["start"].alias("start"), F.lit(1).alias("rank"), s["stop"].alias("stop"), s.cast(SPAN).alias("span"))),
    )

    def free(x):
        covered = _running(F.transform(x, lambda s: F.when(s["rank"] == 0, s["stop"]).otherwise(F.lit(0).cast("long"))), "bigint", F.lit(0).cast("long"), lambda x, y: F.greatest(x, y))
        ahead = F.reverse(_running(F.reverse(F.transform(x, lambda s: F.when(s["rank"] == 0, s["start"]).otherwise(most))), "bigint", most, lambda x, y: F.least(x, y)))
        return common.let(
            covered,
            lambda c: common.let(
                ahead, lambda a: F.transform(F.filter(x, lambda s, i: (s["rank"] == 1) & (F.get(c, i) <= s["start"]) & (F.get(a, i) >= s["stop"])), lambda s: s["span"])
            ),
        )

    return F.when(F.size(some) > 0, common.let(F.array_sort(marked), free)).otherwise(F.array().cast(f"array<{SPAN}>"))


def _best(some: Column) -> Column:
    """Of SPANs by start, those that a sweep keeps: one held gives way to a better one that it overlaps."""
    none = F.array().cast(f"array<{SPAN}>")

    def step(acc, s):
        h = acc["held"]
        better = (s["cost"] < h["cost"]) | ((s["cost"] == h["cost"]) & (s["less"] < h["less"]))
        return F.struct(
            F.when(h.isNull() | (s["start"] >= h["stop"]) | better, s).otherwise(h).alias("held"),
            F.when(h.isNotNull() & (s["start"] >= h["stop"]), F.array_append(acc["out"], h)).otherwise(acc["out"]).alias("out"),
        )

    def block(acc, some_):
        inner = F.aggregate(some_, F.struct(acc["held"].alias("held"), none.alias("out")), step)
        return common.let(inner, lambda r: F.struct(r["held"].alias("held"), F.array_append(acc["out"], r["out"]).alias("out")))

    start = F.struct(F.lit(None).cast(SPAN).alias("held"), F.array().cast(f"array<array<{SPAN}>>").alias("out"))
    swept = common.let(some, lambda x: F.aggregate(_blocks(x), start, block, lambda acc: F.concat(F.flatten(acc["out"]), F.array(acc["held"]))))
    return F.when(F.size(some) > 0, swept).otherwise(none)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans (of the fixed patterns) and every (those and the added ones): kind, start, stop of each."""
    table = common.materialize(candidates(df, id_col, text_col))
    fitted = fit(table)
    thin = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"))
    order = {k: i for i, k in enumerate([*KINDS, *LOOSE])}
    rank = lambda s: F.coalesce(*[F.when(s["kind"] == k, F.lit(i)) for k, i in order.items()])
    in_order = lambda a: F.transform(
        F.array_sort(F.transform(a, lambda s: F.struct(s["start"].alias("start"), rank(s).alias("rank"), s["stop"].alias("stop"), s["kind"].alias("kind")))), thin
    )
    base = F.transform(F.filter("cands", lambda s: s["fixed"] & s["valid"]), thin)
    out = table.select("doc_id", base.alias("base"), F.filter("cands", lambda s: ~s["fixed"] & s["valid"]).alias("loose"))
    added = F.array().cast("array<struct<kind:string,start:bigint,stop:bigint>>")
    if fitted:
        model, least = fitted
        scored = F.transform(
            "loose",
            lambda s: F.struct(
                (-model.column(s["x"])).alias("cost"), (s["start"] - s["stop"]).alias("less"), s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"),
            ),
        )
        limit = lambda s: F.coalesce(*[F.when(s["kind"] == k, F.lit(least.get(f, math.inf))) for k, f in _family().items()])
        # Sums of the same leaves in another order may differ in the last digits.
        out = out.withColumn("passing", F.filter(scored, lambda s: -s["cost"] >= limit(s) - 1e-9))
        out = out.withColumn("free", _apart(F.col("passing"), F.col("base")))
        added = F.transform(_best(F.col("free")), thin)
    return out.select("doc_id", in_order(F.col("base")).alias("spans"), in_order(F.concat("base", added)).alias("every"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(common.documents(spark, sf_dir).select("doc_id", "text"))
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    named = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    return out.select("doc_id", *[n(k) for k in KINDS], F.sha2(named("spans"), 256).alias("base_sha256"), named("every").alias("spans"))
