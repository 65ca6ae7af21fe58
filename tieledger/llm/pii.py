"""Personal data in whole texts: strict base spans, and more that boosted trees choose among looser candidates.

Everything runs on DataFrame functions.  Positions of all matches come from ``regexp_extract_all`` and ``split`` with the
same pattern: the lengths of what stands between the matches and of the matches add up to their places, in code points.  The
sums are made block by block, and contexts come from what stands between matches, so that the work grows with the text.

* Base spans: email, ip, card and phone by fixed rules, leftmost and non-overlapping per kind.
* Candidates: looser generators run over the text with its base spans blanked out.  They also propose what the base rules cannot see:
  addresses written with (at) and dot, spaced or bracketed points, cards in other groups, numbers without a plus, and numbers that the
  base rules drop as they swallow a neighbouring one.
* Each candidate has small categorical features: digits, signs, blanks, separators, whether its format's check holds, words for or
  against it before it.  Whether a base rule matches is no feature and no label.
* Boosted trees are fitted to planted examples: values written in forms that no base rule sees, put at hashed places of a bounded
  sample of documents, against hard negatives: values that fail their check, and such numbers behind words like order, invoice or
  ISBN, versions, list numbers and ends of sentences.  Spark makes, finds and counts them; the driver gets counts by features.
* A kind's threshold is the lowest at which held-out planted examples are at least ``true`` right.  Precision and recall are
  measured on a third part (``Boosted.measured``).

The base patterns are the given ones in a form that never backtracks over long runs: with possessive repetition, and with
matches that begin at the beginning of a run or right after the match before.

Defined cases: a null text counts as empty and has no spans; repeated rows are treated alike; an empty table gives an empty
one, with a model that adds nothing; ``detect`` replaces input columns with the new names, ``redacted`` keeps all.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: In the order in which spans with the same start are listed.
KINDS = ("email", "ip", "card", "phone")
#: The base patterns.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text needs for a match, quickly found.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]+\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){11}", "phone": r"\+[0-9]"}
_DOT = r"(?:\x20?\.\x20?|\x20?[(\[{<](?:\.|dot)[)\]}>]\x20?|\x20dot\x20)"
_AT = r"(?:\x20?@\x20?|\x20?[(\[{<](?:@|at)[)\]}>]\x20?)"
_HOST = r"[a-z0-9-]{1,63}+"
#: Looser generators: kind -> pattern.
LOOSE = {
    "email": rf"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{{1,64}}+(?:{_AT}{_HOST}(?:{_DOT}{_HOST}){{1,4}}+|\x20at\x20{_HOST}(?:\x20dot\x20{_HOST}){{1,4}}+)",
    "ip": rf"(?i)(?<![\p{{L}}0-9.])[0-9]{{1,3}}+(?:{_DOT}[0-9]{{1,3}}+){{3}}(?![0-9])",
    "card": r"(?<![\p{L}0-9]|[0-9][./_:-])(?:[0-9]{13,19}|[0-9]{4}(?:(?:\x20?[./_:-]\x20?|\x20{1,2})[0-9]{4}){3}|[0-9]{4}(?:\x20?[./_:-]\x20?|\x20{1,2})[0-9]{6}(?:\x20?[./_:-]\x20?|\x20{1,2})[0-9]{5})(?![0-9]|[./_:-][0-9])",
    "phone": r"(?<![\p{L}0-9+]|[0-9][./-])(?:(?:\+|00)[0-9]{1,3}[\x20./-]{1,2}|[0-9]{1,3}[\x20./-]{1,2}(?=\())?\(?[0-9]{2,4}\)?[\x20./-]{1,2}[0-9]{3,4}[\x20./-]{1,2}[0-9]{3,4}(?![0-9]|[./-][0-9])",
}
LOOSE_NEEDS = {
    "email": r"(?i)@|[(\[{<]at[)\]}>]|\x20at\x20[a-z0-9-]{1,63}\x20dot\x20",
    "ip": r"(?i)[0-9]\x20?(?:\.|[(\[{<]\.|[(\[{<]?dot)[)\]}>]?\x20?[0-9]",
    "card": r"[0-9]{13}|[0-9]{4}[\x20./_:-]{1,3}[0-9]{4}",
    "phone": r"[0-9]\)?[\x20./-]{1,2}[0-9]{3,4}[\x20./-]{1,2}[0-9]{3}",
}
#: Words before a span that speak for a kind or against any.
CUES = {
    "email": r"(?:mail|write|contact|reach)\W{0,3}\w*\W*$",
    "ip": r"(?:ip|host|server|address|from)\W{0,3}$",
    "card": r"(?:card|visa|credit|master|amex|payment)\W{0,3}\w*\W*$",
    "phone": r"(?:tel|phone|call|fax|mobile|cell)\W{0,3}\w*\W*$",
}
AGAINST = r"(?:isbn|issn|version|v|no|nr|number|id|page|order|invoice|doi|year|\$|€)\W{0,3}$"
#: Phrases that examples are put behind.
FOR_PHRASES = {"email": ["E-mail: ", "write to ", "contact "], "ip": ["IP: ", "server ", "address "], "card": ["card ", "Visa: ", "credit card "], "phone": ["Tel.: ", "call ", "phone "]}
NEUTRAL_PHRASES = ["size ", "see ", "in ", "about ", "and ", "of ", "were "]
AGAINST_PHRASES = ["order ", "invoice no. ", "ISBN ", "version ", "id: ", "page "]

SPAN = "struct<start:int,kind:int,end:int>"
_FOUND = "array<struct<start:int,end:int,s:string,before:string,after:string>>"
#: Characters of context; elements of a block of sums; characters of a chunk.
CONTEXT, BLOCK, CHUNK = 24, 128, 1024


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _last(a: Column) -> Column:
    return F.get(a, F.size(a) - 1)


def _scanned(numbers: Column, op: Callable[[Column, Column], Column]) -> Column:
    """Running results of ``op`` over an array of ints, block by block; null for an empty one."""

    def short(a: Column) -> Column:
        add = lambda out, x: F.concat(out, F.array(F.when(F.size(out) == 0, x).otherwise(op(_last(out), x))))
        return F.aggregate(a, F.array().cast("array<int>"), add)

    def whole(a: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.size(a) - 1, F.lit(BLOCK)), lambda i: short(F.slice(a, i + 1, F.lit(BLOCK))))
        return _let(blocks, joined)

    def joined(blocks: Column) -> Column:
        def shifted(before: Column) -> Column:
            return F.flatten(F.transform(blocks, lambda b, i: F.when(i == 0, b).otherwise(F.transform(b, lambda x: op(x, F.get(before, i - 1))))))

        return _let(short(F.transform(blocks, _last)), shifted)

    return F.when(F.size(numbers) > 0, _let(numbers, whole))


def matches(text: Column, pattern: str, needs: str) -> Column:
    """Places, texts and contexts of all matches: array of struct (start, end, s, before, after), in code points, end exclusive."""
    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), 0).alias("hits"), F.split(text, pattern, -1).alias("gaps"))

    def placed(x: Column) -> Column:
        hits, gaps = x["hits"], x["gaps"]
        ends = _scanned(F.transform(hits, lambda h, i: F.length(F.get(gaps, i)) + F.length(h)), lambda a, b: a + b)

        def one(end: Column, i: Column) -> Column:
            hit = F.get(hits, i)
            before = F.substring(F.concat(F.coalesce(F.get(hits, i - 1), F.lit("")), F.get(gaps, i)), -CONTEXT, CONTEXT)
            return F.struct((end - F.length(hit)).alias("start"), end.alias("end"), hit.alias("s"), before.alias("before"), F.substring(F.get(gaps, i + 1), 1, CONTEXT).alias("after"))

        return F.transform(ends, one)

    return F.coalesce(F.when(text.rlike(needs), _let(both, placed)), F.array().cast(_FOUND))


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check of card numbers."""
    n = F.length(digits)

    def worth(k: Column) -> Column:  # k counts from the right, from 0
        d = F.substring(digits, n - k, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(k % 2 == 0, d).otherwise(twice - F.when(twice > 9, 9).otherwise(0))

    return F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), worth), F.lit(0), lambda s, x: s + x) % 10 == 0


def _passes(kind: str, s: Column) -> Column:
    if kind == "ip":
        # a part of more than three digits may still be at most 255, behind zeros
        parts = F.transform(F.regexp_extract_all(s, F.lit("[0-9]+"), 0), lambda x: F.regexp_replace(x, "^0+", ""))
        return F.forall(parts, lambda x: (F.length(x) <= 3) & (F.coalesce(F.substring(x, 1, 3).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        digits = _digits(s)
        return F.length(digits).between(12, 19) & F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(s)).between(9, 15)
    return F.lit(True)


def base_matches(text: Column, kind: str) -> Column:
    found = matches(text, PATTERNS[kind], NEEDS[kind])
    return found if kind == "email" else F.filter(found, lambda m: _passes(kind, m["s"]))


def _spans(found: Column, kind: str) -> Column:
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), m["end"].alias("end"))).cast(f"array<{SPAN}>")


def _listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def _replaced(text: Column, spans: Column, by: Callable[[Column, Column], Column]) -> Column:
    """The text with its spans, sorted by start, replaced by ``by`` of a span and the length it adds to those before it.

    Where spans overlap, each adds what it reaches beyond the ones before.  What stands between spans is cut from the chunks of
    the text in which it lies, so that no span walks the text from its beginning.
    """

    def cut(x: Column) -> Column:
        chunks, all_spans, ends = x["chunks"], x["spans"], x["ends"]

        def between(a: Column, b: Column) -> Column:
            first, n = F.floor(a / CHUNK).cast("int"), F.floor((b - 1) / CHUNK).cast("int") - F.floor(a / CHUNK).cast("int") + 1
            return F.when(b > a, F.substring(F.array_join(F.slice(chunks, first + 1, n), ""), a % CHUNK + 1, b - a)).otherwise(F.lit(""))

        def one(s: Column, i: Column) -> Column:
            before = F.coalesce(F.get(ends, i - 1), F.lit(0))
            return F.concat(between(before, s["start"]), by(s, F.when(i == 0, s["end"] - s["start"]).otherwise(F.least(s["end"] - s["start"], s["end"] - before))))

        return F.concat(F.array_join(F.transform(all_spans, one), ""), between(_last(ends), x["size"]))

    ends = _scanned(F.transform(spans, lambda s: s["end"]), F.greatest)
    parts = F.struct(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), 0).alias("chunks"), spans.alias("spans"), ends.alias("ends"), F.length(text).alias("size"))
    return F.when(F.size(spans) > 0, _let(parts, cut)).otherwise(text)


def base_spans(text: Column) -> Column:
    """The base spans of all kinds, sorted by start and kind."""
    return F.array_sort(F.concat(*[_spans(base_matches(text, kind), kind) for kind in KINDS]))


def without_base(text: Column, base: Column) -> Column:
    """The text with a sign that is in no pattern in place of each character of a base span; places stay what they are."""
    return _replaced(text, base, lambda s, fresh: F.repeat(F.lit("\x01"), F.greatest(fresh, F.lit(0))))


#: Features of a candidate: name -> number of values.
FEATURES = {"kind": 4, "digits": 20, "marks": 8, "spaced": 8, "cue": 2, "against": 2, "joined": 2, "valid": 2, "lead": 4, "written": 3, "separators": 4}


def _features(kind: str, m: Column) -> list[Column]:
    """Small integers, in the order of FEATURES, of one candidate."""
    s, before, after = m["s"], F.lower(m["before"]), m["after"]
    valid = s.rlike(r"(?<![A-Za-z])[a-z]{2,12}$") if kind == "email" else _passes(kind, s)
    kinds_of_separators = F.size(F.array_distinct(F.regexp_extract_all(s, F.lit("[^A-Za-z0-9]+"), 0)))
    return [
        F.lit(KINDS.index(kind)),
        F.least(F.length(_digits(s)), F.lit(19)),
        F.least(F.length(F.regexp_replace(s, r"[A-Za-z0-9\x20]", "")), F.lit(7)),
        F.least(F.length(F.regexp_replace(s, r"[^\x20]", "")), F.lit(7)),
        before.rlike(CUES[kind]).cast("int"),
        before.rlike(AGAINST).cast("int"),
        (before.rlike(r"[\p{L}\p{N}]$") | after.rlike(r"^[\p{L}\p{N}]")).cast("int"),
        valid.cast("int"),
        F.when(s.startswith("+"), 1).when(s.startswith("00"), 2).when(s.startswith("("), 3).otherwise(0),
        F.when(s.rlike(r"(?i)[(\[{<](?:at|dot|@|\.)[)\]}>]"), 1).when(s.rlike(r"(?i)\x20(?:at|dot)\x20"), 2).otherwise(0),
        F.least(kinds_of_separators, F.lit(3)),
    ]


_CANDIDATE = "array<struct<start:int,end:int,f:array<int>>>"


def candidates(blanked: Column, kind: str) -> Column:
    """Spans of the loose generator of a kind in a text without its base spans, with their features."""
    found = matches(blanked, LOOSE[kind], LOOSE_NEEDS[kind])
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.array(*_features(kind, m)).alias("f"))).cast(_CANDIDATE)


@dataclass
class Boosted:
    """Sum of trees over the features: (feature, at most, left, right) or a value; and precision and recall by kind."""

    prior: float = -6.0
    trees: list = field(default_factory=list)
    least: dict = field(default_factory=dict)
    measured: dict = field(default_factory=dict)

    def margin(self, f) -> float:
        return self.prior + sum(self._of(t, f) for t in self.trees)

    def _of(self, t, f) -> float:
        return self._of(t[2] if f[t[0]] <= t[1] else t[3], f) if isinstance(t, tuple) else t

    def column(self, f: Column) -> Column:
        """The margin as one fold over the trees, which stand in the plan as an array of heaps: features, cuts and values."""
        depth = max(map(_depth, self.trees), default=0)
        heaps = []
        for tree in self.trees:
            level, features, cuts = [tree], [], []
            for _ in range(depth):  # a value stands below a split that nothing parts
                features += [t[0] if isinstance(t, tuple) else 0 for t in level]
                cuts += [t[1] if isinstance(t, tuple) else 99 for t in level]
                level = [x for t in level for x in ((t[2], t[3]) if isinstance(t, tuple) else (t, t))]
            heaps.append({"f": features, "c": cuts, "v": level})
        trees = F.from_json(F.lit(json.dumps(heaps)), "array<struct<f:array<int>,c:array<int>,v:array<double>>>")

        def add(total: Column, t: Column) -> Column:
            # a level lower with each element: the place in the heap
            down = F.aggregate(F.array(*map(F.lit, range(depth))), F.lit(0), lambda i, _: 2 * i + 1 + (F.get(f, F.get(t["f"], i)) > F.get(t["c"], i)).cast("int"))
            return total + F.get(t["v"], down - (2**depth - 1))

        return F.aggregate(trees, F.lit(float(self.prior)), add) if depth else F.lit(float(self.prior))


def _depth(tree) -> int:
    return 1 + max(_depth(tree[2]), _depth(tree[3])) if isinstance(tree, tuple) else 0


def boost(cells: list[tuple[tuple[int, ...], int, int]], held: list[tuple[tuple[int, ...], int, int]], rounds: int = 30, rate: float = 0.4, l2: float = 1.0, depth: int = 3, true: float = 0.98) -> Boosted:
    """Gradient boosting with logistic loss on (features, rows, true rows); thresholds from the held-out cells."""
    model = Boosted()
    if not cells or not sum(c[2] for c in cells):
        return model
    x = np.array([c[0] for c in cells], np.int64)
    rows, hits = (np.array([c[k] for c in cells], float) for k in (1, 2))
    model.prior = math.log((hits.sum() + 0.5) / (rows.sum() - hits.sum() + 0.5))
    margins = np.full(len(cells), model.prior)

    def split(at: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
        whole, best = g[at].sum() ** 2 / (h[at].sum() + l2), (1e-6, None)
        for k, size in enumerate(FEATURES.values() if depth else ()):
            gl, hl = (np.cumsum(np.bincount(x[at, k], v[at], size))[:-1] for v in (g, h))
            gain = gl**2 / (hl + l2) + (g[at].sum() - gl) ** 2 / (h[at].sum() - hl + l2) - whole
            if gain.max() > best[0]:
                best = (gain.max(), (k, int(gain.argmax())))
        if best[1] is None:
            return float(rate * g[at].sum() / (h[at].sum() + l2))
        k, cut = best[1]
        return (k, cut, split(at[x[at, k] <= cut], g, h, depth - 1), split(at[x[at, k] > cut], g, h, depth - 1))

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margins))
        tree = split(np.arange(len(cells)), hits - rows * p, rows * p * (1 - p), depth)
        if not isinstance(tree, tuple):
            break
        model.trees.append(tree)
        margins += np.array([model._of(tree, c[0]) for c in cells])
    for k in range(len(KINDS)):
        own = sorted(((model.margin(f), a, b) for f, a, b in held if f[0] == k), reverse=True)
        n = right = 0
        for i, (m, a, b) in enumerate(own):
            n, right = n + a, right + b
            if (i + 1 == len(own) or own[i + 1][0] < m) and n >= 20 and right >= true * n:
                model.least[k] = m - 1e-9
    return model


def _planted(docs: DataFrame, kind: str) -> DataFrame:
    """One example a document: t (a stretch of the document around a written value), at, till (its place), y, part (0 to 4)."""
    text = F.col("text")

    def drawn(k: int, n: int) -> Column:
        return F.pmod(F.xxhash64(text, F.lit(KINDS.index(kind)), F.lit(k)), F.lit(n)).cast("int")

    def digits(k: int, n: int) -> Column:
        return F.lpad(F.pmod(F.xxhash64(text, F.lit(100 + k)), F.lit(10**n)).cast("string"), n, "0")

    def one_of(k: int, *columns) -> Column:
        each = F.array(*[c if isinstance(c, Column) else F.lit(c) for c in columns])
        return F.get(each, drawn(k, len(columns)))

    def word(k: int) -> Column:
        found = F.regexp_extract(F.substring(text, 1 + drawn(k, 300), F.lit(40)), "([A-Za-z]{2,12})", 1)
        return F.when(found == "", F.lit("office")).otherwise(F.lower(found))

    place = 1 + F.pmod(F.xxhash64(text, F.lit(5)), F.greatest(F.length(text), F.lit(1))).cast("int")
    before, after = F.substring(text, F.greatest(place - 40, F.lit(1)), F.least(place, F.lit(40))), F.substring(text, place, F.lit(40))
    tail, weak = F.lit(""), F.lit(False)  # what follows the value at once; whether the value is one only by what stands before it
    bare_value = None  # what looks like a value and is none, where nothing speaks for it; else the value itself where it is weak
    if kind == "email":
        name, host, top = F.concat(word(1), one_of(2, "", ".", "_"), one_of(3, "", "7", "x", digits(1, 2))), word(4), one_of(5, "com", "org", "net", "de", "co.uk", "example.com")
        at, dot = one_of(6, " (at) ", "(at)", "[at]", " [at] ", " {at} ", " at "), one_of(7, ".", " (dot) ", "[dot]", " [dot] ")
        dot = F.when(at == " at ", F.lit(" dot ")).otherwise(dot)
        true = one_of(8, F.concat(name, at, host, F.regexp_replace(F.concat(F.lit("."), top), F.lit(r"\."), dot)), F.concat(name, F.lit(" @ "), host, F.lit("."), top), F.concat(name, F.lit(" @ "), host, F.lit(" . "), F.lit("com")), F.concat(name, at, host, F.regexp_replace(F.concat(F.lit("."), top), F.lit(r"\."), dot)))
        weak = true.contains(" at ")
        false = one_of(9, F.concat(name, F.lit("@"), host, F.lit(". "), F.initcap(word(10))), F.concat(name, F.lit(" @ "), host, F.lit(" . "), F.initcap(word(10))), F.concat(name, F.lit(" @ "), host, F.lit(". "), F.initcap(word(10))))
        invalid = F.lit(True)
    elif kind == "ip":
        parts = [(1 + drawn(k, 254)).cast("string") for k in range(1, 5)]
        sep = one_of(6, " . ", "[.]", "(.)", " (dot) ", " dot ", "[dot]")
        true = F.concat_ws("|", *parts)
        true = F.replace(true, F.lit("|"), sep)
        # short numbers apart may be a build or a ratio as well
        weak = sep.isin(" . ", " dot ") & (F.length(F.regexp_replace(true, "[^0-9]", "")) < 10)
        small = F.concat_ws("|", one_of(15, (1 + drawn(16, 150)).cast("string"), (1 + drawn(16, 30)).cast("string")), *[drawn(k, 40).cast("string") for k in (17, 18, 19)])
        bare_value = F.replace(small, F.lit("|"), one_of(28, " . ", " dot "))
        wrong = F.replace(F.concat_ws("|", parts[0], (256 + drawn(7, 700)).cast("string"), *parts[2:]), F.lit("|"), sep)
        listed = F.replace(F.concat_ws("|", *[drawn(k, 30).cast("string") for k in range(11, 15)]), F.lit("|"), one_of(8, ". ", " ."))
        false, invalid = F.when(drawn(9, 2) == 0, wrong).otherwise(listed), F.lit(True)
    elif kind == "card":
        body = F.concat(one_of(1, "4", "5", "6"), digits(1, 14))
        checked = F.element_at(F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: F.concat(body, d.cast("string"))), luhn), 1)
        broken = F.concat(body, F.pmod(F.substring(checked, 16, 1).cast("int") + 1 + drawn(2, 8), F.lit(10)).cast("string"))
        sep = one_of(3, ".", "/", "_", "  ", " - ", ". ", ":")
        grouped = lambda s: F.regexp_replace(s, F.lit("(....)(?=.)"), F.concat(F.lit("$1"), sep))
        swallowed = drawn(4, 4) == 0
        tail = F.when(swallowed, F.concat(F.lit(" "), digits(5, 5))).otherwise(F.lit(""))
        true, false = F.when(swallowed, checked).otherwise(grouped(checked)), F.when(swallowed, broken).otherwise(grouped(broken))
        invalid = drawn(6, 4) > 0
    else:
        swallowed = drawn(4, 4) == 0
        area, first, last = F.concat(one_of(1, "2", "3", "5", "7", "8"), digits(1, 2)), digits(2, 3), digits(3, 4)
        sep = one_of(2, "-", ".", " ", "/")
        plus = F.concat(F.lit("+"), (1 + drawn(3, 98)).cast("string"), F.lit(" ("), area, F.lit(") "), first, F.lit("-"), last)
        forms = one_of(5, F.concat(F.lit("("), area, F.lit(") "), first, F.lit("-"), last), F.concat_ws("-", area, first, last), F.concat(area, sep, first, sep, last), F.concat(F.lit("00"), (1 + drawn(3, 98)).cast("string"), sep, area, sep, first, sep, last), F.concat((1 + drawn(3, 98)).cast("string"), F.lit(" ("), area, F.lit(") "), first, F.lit("-"), last))
        tail = F.when(swallowed, F.concat(F.lit(" "), F.concat_ws(".", *[(100 + drawn(k, 155)).cast("string") for k in range(11, 15)]))).otherwise(F.lit(""))
        true = F.when(swallowed, plus).otherwise(forms)
        false, invalid = F.concat(digits(7, 2), sep, digits(8, 3), sep, digits(9, 3)), drawn(6, 4) == 0
        # groups of figures that anything may be: sizes, years, places, parts
        loose = one_of(26, F.concat_ws(" ", digits(9, 3), digits(10, 3), digits(11, 4)), F.concat_ws(" ", *[(1900 + drawn(k, 200)).cast("string") for k in range(31, 35)]), F.concat_ws(" ", *[digits(k, 4) for k in range(12, 16)]), F.concat_ws("-", digits(16, 2), digits(17, 3), digits(18, 4)), F.concat(area, sep, first, sep, last))
        bare_value, weak = loose, ~swallowed & ~true.rlike(r"^00|\(")
    y = drawn(20, 2) == 0
    # a negative fails its check, stands behind a word that says what it is instead, or has nothing that speaks for it
    bare = ~y & (weak if bare_value is None else drawn(25, 2) == 0)
    plain = ~y & ~bare & ~invalid
    value = F.when(bare, true if bare_value is None else bare_value).when(y | plain, true).otherwise(false)
    tail = F.when(bare, F.lit("")).otherwise(tail)
    spoken = weak & y | (drawn(22, 2) == 0)
    phrase = F.when(bare, one_of(27, "", *NEUTRAL_PHRASES)).when(plain, one_of(21, *AGAINST_PHRASES)).when(spoken, one_of(23, *FOR_PHRASES[kind])).otherwise(F.lit(""))
    made = docs.select(before.alias("before"), phrase.alias("phrase"), value.alias("value"), F.when(plain & (tail != ""), F.lit("")).otherwise(tail).alias("tail"), after.alias("after"), y.cast("int").alias("y"), drawn(24, 5).alias("part"))
    head = F.concat("before", F.lit(" "), "phrase")
    return made.select(F.concat(head, "value", "tail", F.lit(" "), "after").alias("t"), F.length(head).alias("at"), (F.length(head) + F.length("value")).alias("till"), "y", "part")


def examples(docs: DataFrame) -> DataFrame:
    """(kind, part, f, y, n): counts of candidates at planted places by features; f is null where a true value has no candidate."""
    made = reduce(DataFrame.unionByName, [_planted(docs, kind).withColumn("kind", F.lit(k)) for k, kind in enumerate(KINDS)])
    made = made.withColumn("base", base_spans(F.col("t")))
    made = made.withColumn("blanked", without_base(F.col("t"), F.col("base")))
    every = reduce(lambda c, k: c.when(F.col("kind") == k, candidates(F.col("blanked"), KINDS[k])), range(1, len(KINDS)), F.when(F.col("kind") == 0, candidates(F.col("blanked"), KINDS[0])))
    found = F.filter(every, lambda m: (m["start"] < F.col("till")) & (m["end"] > F.col("at")))
    close = lambda m: (F.abs(m["start"] - F.col("at")) <= 1) & (F.abs(m["end"] - F.col("till")) <= 1)
    seen = made.select("kind", "part", "y", F.transform(found, lambda m: F.struct(m["f"].alias("f"), (close(m) & (F.col("y") == 1)).cast("int").alias("y"))).alias("c"))
    missed = F.array(F.struct(F.lit(None).cast("array<int>").alias("f"), F.lit(1).alias("y")))
    lost = F.when((F.col("y") == 1) & ~F.exists("c", lambda x: x["y"] == 1), missed).otherwise(F.array().cast("array<struct<f:array<int>,y:int>>"))
    each = seen.select("kind", "part", F.explode(F.concat("c", lost)).alias("x"))
    return each.groupBy("kind", "part", F.col("x.f").alias("f"), F.col("x.y").alias("y")).agg(F.count("*").alias("n"))


def fit(docs: DataFrame, max_docs: int = 12_000) -> Boosted:
    """Fit on examples planted into about ``max_docs`` documents chosen by a hash of the text.

    Of five parts of the examples three are learnt from, one sets the thresholds, one measures precision and recall.
    """
    docs = docs.select("text").where("text IS NOT NULL")
    n = docs.count()
    part = docs.where(F.pmod(F.xxhash64("text"), F.lit(2**31)) < int(2**31 * min(1.0, max_docs / max(1, n))))
    cells: list[dict] = [{}, {}, {}]
    lost = [0] * len(KINDS)
    for r in examples(part).collect():
        to = max(0, r["part"] - 2)
        if r["f"] is None:
            lost[r["kind"]] += r["n"] if to == 2 else 0
            continue
        held = cells[to].setdefault(tuple(r["f"]), [0, 0])
        held[0] += r["n"]
        held[1] += r["n"] * r["y"]
    train, held, test = ([(f, *v) for f, v in sorted(c.items())] for c in cells)
    model = boost(train, held)
    for k, kind in enumerate(KINDS):
        own = [(a, b, model.margin(f) >= model.least.get(k, math.inf)) for f, a, b in test if f[0] == k]
        taken, right, all_true = sum(a for a, _, t in own if t), sum(b for _, b, t in own if t), sum(b for _, b, _ in own) + lost[k]
        model.measured[kind] = (right / max(1, taken), right / max(1, all_true))
    return model


def _chosen(blanked: Column, kind: str, model: Boosted) -> Column:
    """Candidates of a kind at or over its threshold."""
    k = KINDS.index(kind)
    good = F.filter(candidates(blanked, kind), lambda m: model.column(m["f"]) >= model.least[k])
    # the kind is put behind the end, by which they are sorted: leftmost, then longest
    return F.transform(good, lambda m: F.struct(m["start"].alias("start"), (-m["end"]).alias("last"), F.lit(k).alias("kind")))


def detect(docs: DataFrame, model: Boosted, text: str = "text") -> DataFrame:
    """``docs`` with base_<kind> arrays of spans, ``base`` and ``spans``: all spans, each sorted by start and kind."""
    own = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    out = docs
    for kind in KINDS:
        out = out.withColumn(f"base_{kind}", _spans(base_matches(own, kind), kind))
    out = out.withColumn("base", F.array_sort(F.concat(*[F.col(f"base_{k}") for k in KINDS])))
    if not model.least:
        return out.withColumn("spans", F.col("base"))
    loose = reduce(lambda a, b: a | b, [own.rlike(LOOSE_NEEDS[KINDS[k]]) for k in model.least])
    chosen = _let(without_base(own, F.col("base")), lambda t: F.concat(*[_chosen(t, KINDS[k], model) for k in sorted(model.least)]))
    nothing = F.array().cast("array<struct<start:int,last:int,kind:int>>")
    out = out.withColumn("__more", F.array_sort(F.when(loose, chosen).otherwise(nothing)))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))

    def add(a: Column, x: Column) -> Column:
        one = F.struct(x["start"].alias("start"), x["kind"].alias("kind"), (-x["last"]).alias("end"))
        free = x["start"] >= a["at"]
        return F.struct(F.when(free, -x["last"]).otherwise(a["at"]).alias("at"), F.when(free, F.concat(a["out"], F.array(one))).otherwise(a["out"]).alias("out"))

    added = F.when(F.size("__more") > 0, F.aggregate("__more", start, add, lambda a: a["out"])).otherwise(F.array().cast(f"array<{SPAN}>"))
    return out.withColumn("spans", F.array_sort(F.concat("base", added))).drop("__more")


def report(docs: DataFrame, model: Boosted) -> DataFrame:
    """One row per document: doc_id, the counts of base spans, base_sha256 and spans."""
    found = detect(docs.select("doc_id", "text"), model)
    counts = [F.size(f"base_{k}").cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def redacted(docs: DataFrame, model: Boosted, text: str = "text") -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in brackets; overlapping spans become one."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col(f"`{text}`").alias("__text"))
    found = detect(rows, model, "__text").select("__row", "__text", "spans")
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    # a span that begins within the ones before it is part of what stands for them
    by = lambda s, fresh: F.when(fresh == s["end"] - s["start"], F.get(names, s["kind"])).otherwise(F.lit(""))
    new = _replaced(F.col("__text"), F.col("spans"), by)
    return found.withColumn("__new", new).select(*[F.col("__new").alias(c) if c == text else F.col(f"__row.`{c}`").alias(c) for c in docs.columns])
