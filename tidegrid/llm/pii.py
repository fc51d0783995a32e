"""Personal data: high-recall generators, boosted trees over format and context, calibrated thresholds; JVM only.

Fixed patterns give the base spans. Generators propose further, overlapping spans (written-out addresses, numbers without
a country code, other separators, numbers that fail a check digit). Each candidate gets format features and features of
the characters around it, computed by SQL expressions inside its row; boosted depth-two trees, emitted as SQL
conditionals, score it; a threshold by kind, calibrated on held-out examples, selects. Overlapping selections are
resolved by score, and base spans stay. No row is shuffled.

The trees are fitted on the driver on a bounded sample of labelled examples (:data:`EXAMPLES` rows) made from templates
by a fixed rule, through the same feature expressions.

All patterns take each run of characters at once (possessive, anchored at the run's start), so their time is linear in
the text and long runs can't overflow the stack. They find what the plain patterns find from left to right.

Defined results: a null or empty text has no spans; positions are code points, ends exclusive; spans of different kinds
may overlap; rows with a null or repeated ``doc_id`` are judged each by itself; other columns are ignored.
"""

from __future__ import annotations

import json
import math
import random
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: Patterns of the base spans.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+\-]))[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"(?<![0-9])[0-9](?:[ \-]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9\-]+[0-9]"
IP_VALID = r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})){3}$"
#: Patterns of the generators, by kind.
AT_MARK, DOT_WORD = r"(?: ?\(at\) ?| ?\[at\] ?| ?\{at\} ?)", r"(?: ?\(dot\) ?| ?\[dot\] ?| ?\{dot\} ?| dot )"
AT, DOT = r"(?: ?\(at\) ?| ?\[at\] ?| ?\{at\} ?| at | @ )", r"(?: ?\(dot\) ?| ?\[dot\] ?| ?\{dot\} ?| dot | \. |\.)"
_LOCAL, _NAME = r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]{1,64}", r"[A-Za-z0-9\-]{1,63}"
GENERATORS = (
    # What is written out in full, whatever a plainer match before it has taken up.
    (0, rf"(?i){_LOCAL}{AT}{_NAME}(?:{DOT_WORD}{_NAME}){{1,4}}", "words"),
    (0, rf"(?i){_LOCAL}{AT_MARK}{_NAME}(?:{DOT}{_NAME}){{1,4}}", "words"),
    (0, rf"(?i)(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]{{1,64}}{AT}[A-Za-z0-9\-]{{1,63}}(?:{DOT}[A-Za-z0-9\-]{{1,63}}){{1,4}}", "words"),
    (1, r"(?i)(?<![0-9a-f:])(?:[0-9a-f]{1,4}:){2,7}:?[0-9a-f]{1,4}(?![0-9a-f:])", "digits"),
    (1, r"(?<![0-9.])[0-9]{1,3}(?: ?[.,] ?| ?\[\.\] ?| dot )[0-9]{1,3}(?: ?[.,] ?| ?\[\.\] ?| dot )[0-9]{1,3}(?: ?[.,] ?| ?\[\.\] ?| dot )[0-9]{1,3}(?![0-9.])", "digits"),
    (2, r"(?<![0-9])[0-9]{3,6}(?:[ .\-/_]{1,2}[0-9]{2,7}){1,5}(?![0-9])", "digits"),
    (2, r"(?<![0-9])[0-9]{12,19}(?![0-9])", "digits"),
    (3, r"(?<![0-9+])\(?[0-9]{2,5}\)?(?:[ .\-/]{1,2}\(?[0-9]{2,5}\)?){1,4}(?![0-9])", "digits"),
    (3, r"(?<![0-9])(?:00[1-9]|0[1-9])[0-9]{7,12}(?![0-9])", "digits"),
)
#: What any match of the e-mail generator holds.
WORDS = rf"(?i)[A-Za-z0-9._%+\-]{AT}[A-Za-z0-9\-]{{1,63}}{DOT}[A-Za-z0-9\-]"
#: Words of the context, by what they speak for.
CONTEXT = {
    "says_mail": r"(?i)(?:e-?mail|contact|reach|write to|mailto|correo|courriel)",
    "says_ip": r"(?i)(?:\bip\b|ipv[46]|address|host|server|addr|login from)",
    "says_card": r"(?i)(?:card|visa|master|amex|credit|debit|\bcc\b|karte|carte|tarjeta)",
    "says_phone": r"(?i)(?:phone|tel\b|tel[.:]|call|mobile|cell|fax|whatsapp|telefon|tél|teléfono)",
    "says_other": r"(?i)(?:order|invoice|isbn|version|serial|\bref\b|\bid\b|item|page|chapter|date|build|release|ticket|total)",
}
FEATURES = ("kind_email", "kind_ip", "kind_card", "kind_phone", "length", "digits", "separators", "dots", "luhn", "octets", "groups", "parens", "marked", "prefixed", "glued", *CONTEXT)
BEFORE, AFTER = 24, 8
#: Bound of the labelled sample.
EXAMPLES = 1800


def folded(items: Column, first: Column, kind: str, step: Callable[[Column, Column], tuple[Column, Column]], block: int = 128) -> Column:
    """A fold that gives an array: ``step`` turns what is carried and an item to what is carried on and an output (null:
    none). Outputs are put together by blocks, so that no long array is copied for each item. What is carried at the end
    is lost; ``kind`` is the outputs' type."""
    nothing = F.array().cast(f"array<{kind}>")

    def one(acc: Column, x: Column) -> Column:
        carried, out = step(acc["c"], x)
        return F.struct(carried.alias("c"), F.when(out.isNull(), acc["a"]).otherwise(F.concat(acc["a"], F.array(out))).alias("a"))

    def whole(acc: Column, b: Column) -> Column:
        inner = F.array(F.aggregate(b, F.struct(acc["c"].alias("c"), nothing.alias("a")), one))
        return F.transform(inner, lambda r: F.struct(r["c"].alias("c"), F.concat(acc["a"], F.array(r["a"])).alias("a")))[0]

    def all_of(a: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(a) - 1) / block).cast("int"))), lambda b: F.slice(a, b * block + 1, block))
        return F.flatten(F.aggregate(blocks, F.struct(first.alias("c"), F.array().cast(f"array<array<{kind}>>").alias("a")), whole)["a"])

    return once(items, all_of)


def once(value: Column, made: Callable[[Column], Column]) -> Column:
    """What ``made`` makes of a value that it names more than once: the value is worked out once."""
    return F.transform(F.array(value), made)[0]


SPAN = "array<struct<start:int,kind:int,end:int,own:string>>"


def found(text: Column, pattern: str, kind: int, gate: Column) -> Column:
    """All matches as ``start, kind, end, own``: the pieces between them give their places."""
    nothing = F.array().cast(SPAN)
    # The text is cut into piece, match, piece, match ...: a fold over pairs carries where each begins.
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    pairs = F.filter(F.arrays_zip(pieces.alias("p"), matches.alias("m")), lambda z: z["m"].isNotNull())  # one piece more than matches

    def step(at: Column, z: Column) -> tuple[Column, Column]:
        start = at + z["p"]
        end = start + F.length(z["m"])
        return end, F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), z["m"].alias("own"))

    spans = folded(pairs, F.lit(0), SPAN.removeprefix("array<").removesuffix(">"), step)
    return F.when(gate & text.rlike(pattern), spans).otherwise(nothing).cast(SPAN)


def digits_of(own: Column) -> Column:
    """The digits of a string."""
    return F.regexp_replace(own, "[^0-9]", "")


def _luhn(number: Column) -> Column:
    return F.call_function("luhn_check", number)


def valid(kind: int, own: Column) -> Column:
    """The check that a base match must pass."""
    n = F.length(digits_of(own))
    return (F.lit(True), own.rlike(IP_VALID), n.between(12, 19) & _luhn(digits_of(own)), n.between(9, 15))[kind]


def _possible(spans: Column, kind: int) -> Column:
    """Candidates with a count of digits that their kind can have."""
    low, high = ((0, 64), (3, 64), (12, 19), (9, 15))[kind]
    return F.filter(spans, lambda s: F.length(digits_of(s["own"])).between(low, high))


def _checked(spans: Column, kind: int) -> Column:
    return F.filter(spans, lambda s: valid(kind, s["own"]))


def base_spans(text: Column, at: Column, digits: Column) -> list[Column]:
    """Base spans by kind."""
    out = []
    for kind, (pattern, gate) in enumerate(((EMAIL, at), (IP, digits), (CARD, digits), (PHONE, digits))):
        spans = found(text, pattern, kind, gate)
        out.append(spans if kind == 0 else _checked(spans, kind))
    return out


def features(kind: Column, own: Column, before: Column, after: Column) -> dict[str, Column]:
    """Format and context features of a candidate, as doubles."""
    number = digits_of(own)
    flag = {
        "kind_email": kind == 0, "kind_ip": kind == 1, "kind_card": kind == 2, "kind_phone": kind == 3,
        "luhn": F.length(number).between(12, 19) & _luhn(number),
        "octets": own.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])[^0-9]+){3}0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"),
        "groups": own.rlike(r"^(?:[0-9]{4}[^0-9]{1,2}){3}[0-9]{4}$|^[0-9]{4}[^0-9]{1,2}[0-9]{6}[^0-9]{1,2}[0-9]{5}$|^\(?[0-9]{3}\)?[^0-9]{1,2}[0-9]{3}[^0-9]{1,2}[0-9]{4}$"),
        "parens": own.rlike(r"\([0-9]{2,5}\)"), "marked": own.rlike(r"(?i)[\[({](?:at|dot)[\])}]|@"), "prefixed": own.rlike(r"^0"),
        "glued": before.rlike(r"[\p{L}0-9_$#%.,/:\-]$") | after.rlike(r"^[\p{L}0-9_%/:]"),
    }
    count = {"length": F.length(own), "digits": F.length(number), "separators": F.length(F.regexp_replace(own, r"[^ .,\-/_:]", "")), "dots": F.length(F.regexp_replace(F.regexp_replace(F.lower(own), r"\bdot\b", "."), r"[^.]", ""))}
    says = {k: before.rlike(v) for k, v in CONTEXT.items()}
    got = count | flag | says
    return {k: got[k].cast("double") for k in FEATURES}


@dataclass(frozen=True)
class Tree:
    """A tree of depth two: a root test ``feature < at`` and a test below each side; four values."""

    root: tuple[int, float]
    left: tuple[int, float]
    right: tuple[int, float]
    values: tuple[float, float, float, float]

    def column(self, x) -> Column:
        """The tree as a SQL conditional; ``x(i)`` is feature i."""
        side = [F.when(x(i) < at, F.lit(a)).otherwise(F.lit(b)) for (i, at), (a, b) in ((self.left, self.values[:2]), (self.right, self.values[2:]))]
        return F.when(x(self.root[0]) < self.root[1], side[0]).otherwise(side[1])

    def predict(self, x: np.ndarray) -> np.ndarray:
        """The same on an array."""
        one = np.where(x[:, self.left[0]] < self.left[1], self.values[0], self.values[1])
        two = np.where(x[:, self.right[0]] < self.right[1], self.values[2], self.values[3])
        return np.where(x[:, self.root[0]] < self.root[1], one, two)


@dataclass(frozen=True)
class Model:
    """Boosted trees, their first score, and a threshold of the score by kind."""

    trees: tuple[Tree, ...]
    first: float
    thresholds: tuple[float, float, float, float]

    def score(self, x) -> Column:
        """The summed score as a column."""
        return sum((t.column(x) for t in self.trees), F.lit(self.first))


def _best(x: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray) -> tuple[float, tuple[int, float], np.ndarray]:
    best = (-1.0, (0, -math.inf), np.zeros(len(rows), bool))
    gs, hs = g[rows].sum(), h[rows].sum()
    for i in range(x.shape[1]):
        v = x[rows, i]
        for at in np.unique(np.quantile(v, (0.1, 0.25, 0.5, 0.75, 0.9))) if len(rows) else ():
            for cut in (at, np.nextafter(at, math.inf)):
                low = v < cut
                if 5 <= low.sum() <= len(rows) - 5:
                    a, b = g[rows][low].sum(), h[rows][low].sum()
                    gain = a * a / (b + 1) + (gs - a) ** 2 / (hs - b + 1) - gs * gs / (hs + 1)
                    if gain > best[0]:
                        best = (gain, (i, float(cut)), low)
    return best


def boosted(x: np.ndarray, y: np.ndarray, rounds: int = 30, rate: float = 0.3) -> tuple[tuple[Tree, ...], float]:
    """Gradient boosting of depth-two trees under logistic loss."""
    first = math.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
    score, trees, everything = np.full(len(y), first), [], np.arange(len(y))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        _, root, low = _best(x, g, h, everything)
        sides, values = [], []
        for rows in (everything[low], everything[~low]):
            _, test, under = _best(x, g, h, rows)
            sides.append(test)
            values += [float(rate * g[r].sum() / (h[r].sum() + 1)) for r in (rows[under], rows[~under])]
        trees.append(Tree(root, sides[0], sides[1], tuple(values)))
        score = score + trees[-1].predict(x)
    return tuple(trees), first


def examples(n: int = EXAMPLES, seed: int = 11) -> list[tuple[int, str, str, str, int]]:
    """Labelled candidates ``kind, own, before, after, label`` from templates."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(("th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha")) for _ in range(rng.randint(1, 4)))
    digits = lambda k: "".join(str(rng.randint(0, 9)) for _ in range(k))

    def luhn(k: int, good: bool = True) -> str:
        body = digits(k - 1)
        for last in "0123456789":
            total = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(body + last)))
            if (total % 10 == 0) == good:
                return body + last
        return body

    cue = {0: ("email: ", "contact me at ", "write to ", "reach us: "), 1: ("ip ", "server address: ", "host ", "login from "), 2: ("credit card ", "visa: ", "card no. ", "cc "), 3: ("phone: ", "call ", "tel. ", "mobile ", "fax ")}
    other = ("order ", "invoice no. ", "isbn ", "version ", "serial ", "ref ", "id ", "total ", "page ", "date ")
    out = []
    while len(out) < n:
        kind = rng.randrange(4)
        sep = rng.choice((" ", "-", ".", "/"))
        plain = f"{word()} {word()} "
        good = rng.random() < 0.5
        mood = rng.random()
        before = plain + (rng.choice(cue[kind]) if good and mood < 0.7 else rng.choice(other) if not good and mood < 0.6 else "")
        after = rng.choice((f" {word()} ", ". " + word(), ", " + word(), ""))
        if kind == 0:
            at, dot = rng.choice((("(at)", "(dot)"), ("[at]", "[dot]"), (" (at) ", " (dot) "), (" at ", " dot "), ("[at]", ".")))
            local = rng.choice((f"{word()}.{digits(2)}", f"{word()}.{word()}", word(), f"{word()}_{word()}"))
            own = f"{local}{at}{word()}{rng.choice(('', digits(1)))}{rng.choice((dot + 'example', ''))}{dot}{rng.choice(('com', 'org', 'net', 'de'))}" if good else f"{word()} at {word()}{rng.choice(('.', '. '))}{word().capitalize()}"
        elif kind == 1:
            octets = [str(rng.randint(0, 255)) for _ in range(4)]
            own = rng.choice((" . ", "[.]", " dot ")).join(octets) if good else rng.choice((",", ", ", ".")).join(digits(rng.randint(1, 3)) for _ in range(4))
            if rng.random() < 0.4:
                own = ":".join(f"{rng.randrange(65536):x}" for _ in range(8)) if good else ":".join(f"{rng.randrange(60):02d}" for _ in range(3))
        elif kind == 2:
            own = luhn(16, good or rng.random() < 0.1)
            shape = rng.random()
            if good or shape < 0.4:
                own = sep.join(own[i : i + 4] for i in range(0, 16, 4)) if shape < 0.8 else own
            elif shape < 0.7:
                own = f"{digits(4)}{sep}{digits(2)}{sep}{digits(2)}"
            if good and mood < 0.7 and rng.random() < 0.3:
                own = sep.join(luhn(16, False)[i : i + 4] for i in range(0, 16, 4))
        else:
            own = rng.choice((f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}{sep}{digits(3)}{sep}{digits(4)}", f"00{rng.randint(1, 9)}{digits(10)}", f"0{rng.randint(1, 9)}{digits(2)} {digits(3)} {digits(4)}")) if good else rng.choice((f"{digits(4)}-{digits(2)}-{digits(2)}", f"{digits(2)}/{digits(2)}/{digits(4)}", f"{digits(3)}.{digits(2)}", f"{digits(4)} {digits(4)}", f"{digits(3)}-{digits(1)}{digits(1)}-{digits(5)}"))
        if not good and rng.random() < 0.2:
            before = before.rstrip() + rng.choice(("#", "v", "x", "$"))
        out.append((kind, own, before[-BEFORE:], after[:AFTER], int(good)))
    return out


Example = tuple[int, str, str, str, int]
_fitted: dict[str, Model] = {}


def _features(spark: SparkSession, rows: Sequence[Example]) -> np.ndarray:
    """Kind, label and features of candidates ``kind, own, before, after, label``."""
    text = json.dumps([dict(zip(("kind", "own", "before", "after", "label"), r, strict=True)) for r in rows])
    given = spark.range(1).select(F.posexplode(F.from_json(F.lit(text), "array<struct<kind:int,own:string,before:string,after:string,label:int>>")).alias("at", "r")).select("at", "r.*")
    x = features(F.col("kind"), F.col("own"), F.col("before"), F.col("after"))
    return np.array([list(r)[1:] for r in sorted(given.select("at", "kind", "label", *[c.alias(k) for k, c in x.items()]).collect())], float)


def fitted(spark: SparkSession, labelled: Sequence[Example] | None = None, precision: float = 0.97) -> Model:
    """A model from labelled candidates (at most ``EXAMPLES``; by default those made from templates, fitted once for an
    application): every third one only calibrates the thresholds, by kind the least score from which the share of real
    ones is ``precision``."""
    known = spark.sparkContext.applicationId
    if labelled is None and known in _fitted:
        return _fitted[known]
    got = _features(spark, list(labelled if labelled is not None else examples())[:EXAMPLES])
    held = np.arange(len(got)) % 3 == 0
    trees, first = boosted(got[~held, 2:], got[~held, 1])
    score = first + sum(t.predict(got[held, 2:]) for t in trees)
    kinds, labels, at = got[held, 0], got[held, 1], []
    for kind in range(len(KINDS)):
        own = kinds == kind
        order = np.argsort(-score[own])
        right = np.cumsum(labels[own][order]) / np.arange(1, own.sum() + 1)
        good = np.flatnonzero(right >= precision)
        at.append(max(0.5, float(score[own][order][good[-1]]) if len(good) else math.inf))
    model = Model(trees, first, tuple(at))
    if labelled is None:
        _fitted.clear()
        _fitted[known] = model
    return model


def scored(text: Column, candidates: Column, model: Model) -> Column:
    """Candidates above their kind's threshold, with their score."""

    def features_of(c: Column) -> Column:
        before = F.substring(text, F.greatest(F.lit(1), c["start"] - BEFORE + 1), F.least(F.lit(BEFORE), c["start"]))
        after = F.substring(text, c["end"] + 1, F.lit(AFTER))
        x = features(c["kind"], c["own"], before, after)
        return F.struct(c.alias("c"), F.array(*[x[k] for k in FEATURES]).alias("x"))

    def score_of(z: Column) -> Column:
        return F.struct(z["c"]["start"].alias("start"), z["c"]["kind"].alias("kind"), z["c"]["end"].alias("end"), model.score(lambda i: z["x"][i]).alias("score"))

    limits = F.array(*[F.lit(t) for t in model.thresholds])
    return F.filter(F.transform(F.transform(candidates, features_of), score_of), lambda s: s["score"] >= limits[s["kind"]])


def resolved(chosen: Column, base: Column) -> Column:
    """Selections that overlap no base span; of selections that overlap each other the one with the best score."""
    kind = "struct<start:int,kind:int,end:int,score:double>"
    none = F.lit(None).cast(kind)
    # All spans in order; base spans (without a score) reach over what begins before their furthest end so far, and in the
    # other direction a selection reaches over the base spans that begin before its end.
    plain = F.transform(base, lambda b: F.struct(b["start"].alias("start"), b["kind"].alias("kind"), b["end"].alias("end"), F.lit(None).cast("double").alias("score")))
    whole = F.array_sort(F.concat(chosen, plain).cast(f"array<{kind}>"))

    def forth(reach: Column, s: Column) -> tuple[Column, Column]:
        is_base = s["score"].isNull()
        return F.when(is_base, F.greatest(reach, s["end"])).otherwise(reach), F.when(is_base | (reach <= s["start"]), s).otherwise(none)

    def back(begin: Column, s: Column) -> tuple[Column, Column]:
        is_base = s["score"].isNull()
        return F.when(is_base, F.least(begin, s["start"])).otherwise(begin), F.when(~is_base & (begin >= s["end"]), s).otherwise(none)

    ahead = folded(whole, F.lit(-1), kind, forth)
    free = F.reverse(folded(F.reverse(ahead), F.lit(2**31 - 1), kind, back))

    def step(last: Column, s: Column) -> tuple[Column, Column]:
        crosses = last.isNotNull() & (s["start"] < last["end"])
        return F.when(crosses & (s["score"] <= last["score"]), last).otherwise(s), F.when(crosses, none).otherwise(last)

    # One more item, beyond all others, brings out the last.
    end = F.array(F.struct(F.lit(2**31 - 1).alias("start"), F.lit(0).alias("kind"), F.lit(2**31 - 1).alias("end"), F.lit(0.0).alias("score")).cast(kind))
    return folded(F.concat(free, end), none, kind, step)


def written(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat(names[s["kind"]], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def spans_of(rows: DataFrame, model: Model) -> DataFrame:
    """``rows`` (with a column ``text``, never null) with ``base``, the spans of the fixed patterns, and ``more``, those that
    the trees select; both in order."""
    text, kept = F.col("text"), [c for c in rows.columns if c != "text"]
    kind = "array<struct<start:int,kind:int,end:int>>"
    plain = lambda spans: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    rows = rows.select(*kept, "text", F.contains(text, F.lit("@")).alias("_at"), text.rlike("[0-9]").alias("_digits"), text.rlike(WORDS).alias("_words"))
    base = base_spans(text, F.col("_at"), F.col("_digits"))
    proposed = [_possible(found(text, pattern, kind, F.col(f"_{gate}")), kind) for kind, pattern, gate in GENERATORS]
    rows = rows.select(*kept, "text", F.array_sort(plain(F.concat(*base))).alias("base"), F.array_distinct(F.concat(*proposed)).alias("_proposed"))
    more = F.when(F.size("_proposed") > 0, resolved(scored(text, F.col("_proposed"), model), F.col("base")))
    return rows.select(*kept, "text", "base", F.coalesce(plain(more), F.array().cast(kind)).alias("more"))


def scanned(docs: DataFrame, *, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """By row ``doc_id``, counts of the base kinds, the digest of their spans, all spans, and their number."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = spans_of(rows, model or fitted(docs.sparkSession))

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    every = F.concat("base", "more")
    return rows.select("doc_id", *counts, F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.array_sort(every)).alias("spans"), F.size(every).cast("long").alias("n_spans"))


def redacted(docs: DataFrame, *, model: Model | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; of spans that overlap, the first and what reaches over its
    end are one. A null text stays null; a column ``n_chars`` follows the text."""
    names = docs.columns
    inner = [f"_c{i}" for i in range(len(names))]  # whatever the columns are called
    own = inner[names.index(text_col)]
    rows = docs.toDF(*inner).withColumn("text", F.coalesce(F.col(own).cast("string"), F.lit("")))
    rows = spans_of(rows, model or fitted(docs.sparkSession))
    kind, none = "struct<start:int,kind:int,end:int>", F.lit(None).cast("struct<start:int,kind:int,end:int>")

    def step(last: Column, s: Column) -> tuple[Column, Column]:
        crosses = last.isNotNull() & (s["start"] < last["end"])
        one = F.struct(last["start"].alias("start"), last["kind"].alias("kind"), F.greatest(last["end"], s["end"]).alias("end"))
        return F.when(crosses, one).otherwise(s), F.when(crosses, none).otherwise(last)

    end = F.array(F.struct(F.lit(2**31 - 2).alias("start"), F.lit(0).alias("kind"), F.lit(2**31 - 2).alias("end")).cast(kind))
    apart = F.concat(folded(F.concat(F.array_sort(F.concat("base", "more")), end), none, kind, step), end)
    marks = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    pieces = folded(apart, F.lit(0), "string", lambda at, s: (s["end"], F.concat(F.substring(F.col("text"), at + 1, s["start"] - at), F.when(s["start"] < 2**31 - 2, marks[s["kind"]]).otherwise(F.lit("")))))
    text = F.when(F.col(own).isNotNull(), F.array_join(pieces, ""))
    rows = rows.withColumn(own, text)
    if "n_chars" in names:
        at = inner[names.index("n_chars")]
        rows = rows.withColumn(at, F.length(own).cast(docs.schema["n_chars"].dataType))
    return rows.select(*inner).toDF(*names)
