"""Personal data by candidate gradient boosting, by DataFrame functions.

Four base kinds are found by exact patterns and checks and always stay. Beside them, generators of high recall propose
spans of the same kinds that may overlap each other and base spans: addresses written with (at) and (dot), dotted numbers,
long digit groups, telephone-like groups without a plus sign. Boosted trees over features of format and context score each
proposal, and proposals whose score reaches their kind's threshold are added where no base span lies.

There are no labels for personal data, so the trees learn from the checks: proposals that the base patterns' checks
confirm, as they stand or in normal form ((at) and (dot) as signs, cards without dots), are positive, proposals that they
refute (octets over 255, failed check digits, wrong lengths) are negative, and the check's own outcome is no feature.
Forms without a mark have no check, so confirmed spans are made into them: telephone numbers without their plus sign,
country code and context, mails with (at). A number without plus sign is negative if its groups are those of no telephone
number or it meets a base span of another kind, and else trains nothing. Refuted proposals are never added, and the
thresholds' precision is that of forms which no base span meets. All documents' proposals count: they are summed by
feature vector, of which there are few as every feature has few values, and the trees are fitted to these sums on the driver. Thresholds
are the lowest at which proposals of the fold kept out reach the wanted precision; a kind that never does adds nothing.

Null and empty texts have no spans. Positions are code points, ends exclusive. Repeated rows give equal results.
Patterns use possessive repeats, so long texts take linear time and no stack.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialise

KINDS = ("email", "ip", "card", "phone")

#: Base patterns, made possessive: a run begins where no character of its class stands before it, or right after a match.
_BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[ -][0-9]++)*+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
_WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?+(?:@|[\[(](?:at|AT)[\])]) ?+[A-Za-z0-9-]++(?:(?:\.| \. | ?+[\[(](?:dot|DOT)[\])] ?+)[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9.])[0-9]{1,4}+(?:\.[0-9]{1,4}+){2,5}+",
    "card": r"(?<![0-9])[0-9]{3,}+(?:[ .-][0-9]{3,}+)*+",
    "phone": r"(?:\+ ?+)?+\(?+[0-9]++\)?+(?:[ .-]\(?+[0-9]++\)?+){1,6}+",
}
_CONTEXT = {
    "email": r"(?i)(?:e-?mail|mailto|contact|write to)\W*+$",
    "ip": r"(?i)(?:\bip|host|server|address|from)\W*+$",
    "card": r"(?i)(?:card|visa|master|credit|amex|payment)\W*+$",
    "phone": r"(?i)(?:tel|phone|call|fax|mobile|cell)\W*+$",
}


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check of payment cards."""
    n = F.length(digits)
    code = lambda i: F.ascii(F.substr(digits, n - i, F.lit(1))) - 48
    twice = lambda i: F.when(i % 2 == 1, F.when(code(i) > 4, 2 * code(i) - 9).otherwise(2 * code(i))).otherwise(code(i))
    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda s, i: s + twice(i)) % 10 == 0


def checked(kind: str, text: Column) -> Column:
    """Whether a match of the kind's pattern passes its check."""
    digits = _digits(text)
    if kind == "ip":
        return text.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


_SPANS = "array<struct<start:int,end:int,text:string,before:string,after:string>>"
_CHUNK = 64


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is named."""
    return F.element_at(F.transform(F.array(value), use), 1)


def matches(text: Column, pattern: str, needs: Column, context: bool = False) -> Column:
    """start, end (code points) and text of all matches, left to right; ``needs``: whether there can be any.

    context: with up to 20 characters before a match (and after the one before that) and the one after it. Starts are
    sums over the gaps: of chunks first, then inside each, so that a text's many matches take time in proportion.
    """
    nothing = F.array().cast(_SPANS)
    size = lambda p: p["gap"] + F.length(p["text"])

    def pieces(found: Column, gaps: Column) -> Column:
        def of(m: Column, i: Column) -> Column:
            gap = F.get(gaps, i)
            before = F.right(F.concat(F.coalesce(F.get(found, i - 1), F.lit("")), gap), F.lit(20)) if context else F.lit("")
            after = F.left(F.concat(F.get(gaps, i + 1), F.coalesce(F.get(found, i + 1), F.lit(""))), F.lit(1)) if context else F.lit("")
            return F.struct(F.length(gap).alias("gap"), m.alias("text"), before.alias("before"), after.alias("after"))

        return F.transform(found, of)

    def chunk(all_: Column, c: Column) -> Column:
        return F.slice(all_, c * _CHUNK + 1, F.lit(_CHUNK))

    def step(s: Column, x: Column) -> Column:
        start = s["at"] + x["gap"]
        end = start + F.length(x["text"])
        return F.struct(end.alias("at"), F.concat(s["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["text"].alias("text"), x["before"].alias("before"), x["after"].alias("after")))).alias("out"))

    def placed(all_: Column) -> Column:
        chunks = F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / _CHUNK).cast("int"))
        totals = F.transform(chunks, lambda c: F.aggregate(chunk(all_, c), F.lit(0), lambda s, p: s + size(p)))
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        starts = F.aggregate(totals, zero, lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])
        inside = lambda at, c: F.aggregate(chunk(all_, c), F.struct(at.alias("at"), nothing.alias("out")), step, lambda s: s["out"])
        return F.when(F.size(all_) == 0, nothing).otherwise(F.flatten(F.transform(starts, inside)))

    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("gaps"))
    spans = _bound(both, lambda x: _bound(x["found"], lambda found: _bound(x["gaps"], lambda gaps: _bound(pieces(found, gaps), placed))))
    return F.when(needs, spans).otherwise(nothing)


def _first_after(spans: Column, start: Column) -> Column:
    """The index of the first of disjoint spans in order that ends after ``start``, by halving."""
    zero = F.struct(F.lit(0).alias("lo"), F.size(spans).alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        left = F.get(spans, mid)["end"] > start
        going = s["lo"] < s["hi"]
        return F.struct(F.when(going & ~left, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(going & left, mid).otherwise(s["hi"]).alias("hi"))

    return F.aggregate(F.sequence(F.lit(0), F.length(F.bin(F.size(spans)))), zero, halve, lambda s: s["lo"])


def _near(spans: Column, m: Column, test: Callable[[Column], Column]) -> Column:
    """Whether ``test`` holds for the first span that ends after a match begins, or for the next one."""
    ok = lambda b: F.coalesce(test(b), F.lit(False))
    return _bound(_first_after(spans, m["start"]), lambda i: ok(F.get(spans, i)) | ok(F.get(spans, i + 1)))


def _checker(kind: str):
    return lambda m: checked(kind, m["text"])


def _base(text: Column) -> dict[str, Column]:
    out = {}
    for kind in KINDS:
        pattern, needs = _BASE[kind], F.contains(text, F.lit(_NEEDS[kind]))
        if kind != "email":
            needs = needs & text.rlike(r"[0-9]")
        if kind == "card":
            needs = text.rlike(r"[0-9](?:[ -]?+[0-9]){13}")
        out[kind] = F.filter(matches(text, pattern, needs, context=kind in ("email", "phone")), _checker(kind))
    return out


#: Features of a proposal and the number of values of each.
FEATURES = {"digits": 9, "groups": 6, "regular": 2, "lead": 4, "plus": 2, "bracket": 2, "separators": 4, "context": 2, "word_before": 2, "word_after": 2}


_MARKED = r"[\[(](?:at|AT|dot|DOT)[\])]"
_MAIL = r"^[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]++\.)++[A-Za-z]{2,}$"
_PHONE = r"^\+?[0-9]{0,3} ?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}$"


def normal(kind: str, text: Column) -> Column:
    """A proposal as the base patterns would have it: (at) and (dot) as signs, cards without dots."""
    if kind == "email":
        return F.regexp_replace(F.regexp_replace(text, r" ?[\[(](?:at|AT)[\])] ?", "@"), r" ?[\[(](?:dot|DOT)[\])] ?", ".")
    return F.translate(text, ".", " ") if kind == "card" else text


def possible(kind: str, text: Column) -> Column:
    """Whether the check does not refute a proposal that no base span meets."""
    if kind == "email":
        return text.rlike(_MARKED) & normal(kind, text).rlike(_MAIL)
    return checked(kind, text)


def _features(kind: str, m: Column) -> Column:
    marked = m["text"].rlike(_MARKED if kind == "email" else r"[()\[\]]")
    before, after = m["before"], m["after"]
    m = F.struct(normal(kind, m["text"]).alias("text"))
    digits = F.length(_digits(m["text"]))
    groups = F.size(F.split(F.regexp_replace(m["text"], "^[^0-9A-Za-z]+|[^0-9A-Za-z]+$", ""), "[^0-9A-Za-z]+", -1))
    first = F.substr(_digits(m["text"]), F.lit(1), F.lit(1))
    separators = F.length(F.regexp_replace(m["text"], r"^\+ ?|[0-9A-Za-z]", ""))
    flag = lambda c: c.cast("int")
    return F.struct(
        F.when(digits < 8, F.lit(0)).otherwise(F.least(digits - 7, F.lit(8))).alias("digits"),
        F.least(groups, F.lit(5)).alias("groups"),
        flag(m["text"].rlike(r"^(?:[0-9]{4}[ -]){3}[0-9]{4}$|^\+?[0-9]{0,3} ?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}$|^[0-9]{14,16}$|^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$|^[^ ]+@[^ ]+\.[A-Za-z]{2,}$")).alias("regular"),
        F.when(first == "4", 1).when(first.isin("3", "5", "6"), 2).when(first.isin("0", "1"), 3).otherwise(0).alias("lead"),
        flag(m["text"].startswith("+")).alias("plus"),
        flag(marked).alias("bracket"),
        F.least(separators, F.lit(3)).alias("separators"),
        flag(before.rlike(_CONTEXT[kind])).alias("context"),
        flag(before.rlike(r"[\p{L}\p{N}_]$")).alias("word_before"),
        flag(after.rlike(r"[\p{L}\p{N}_]")).alias("word_after"),
    )


def find_candidates(documents: DataFrame) -> DataFrame:
    """doc_id, fold, base (array of kind, start, end), proposed and made.

    proposed: kind, start, end, y (confirmed 1, refuted 0, null if neither), met (by a base span of its kind), may (be added: not refuted, no base span there), f
    (features). made: kind and f of confirmed spans in forms without a mark.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = documents.select(F.col("doc_id").cast("long"), text.alias("text"))
    own = _base(F.col("text"))
    docs = docs.select("doc_id", "text", *(own[k].alias(f"b_{k}") for k in KINDS))

    def placed(number: int):
        return lambda m: F.struct(m["start"].alias("start"), F.lit(number).alias("kind"), m["end"].alias("end"))

    def described(number: int, kind: str):
        def of(m: Column) -> Column:
            meets = lambda b: (b["start"] <= m["start"]) & (b["end"] >= m["end"]) | (b["start"] >= m["start"]) & (b["end"] <= m["end"])
            over = lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])
            met, may, taken = _near(F.col(f"b_{kind}"), m, meets), possible(kind, m["text"]), F.lit(False)
            for k in KINDS:
                taken = taken | _near(F.col(f"b_{k}"), m, over)
            f = _features(kind, m).alias("f")
            told = F.struct(met.alias("met"), may.alias("may"), taken.alias("taken"))

            def judged(t: Column) -> Column:
                truth = F.when(t["met"], 1).when(t["may"], 1).otherwise(0)
                if kind == "phone":
                    truth = F.when(t["met"], 1).when(t["taken"] | ~t["may"] | ~m["text"].rlike(_PHONE), 0)
                may_be = t["may"] & ~t["taken"]
                return F.struct(F.lit(number).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), truth.alias("y"), t["met"].alias("met"), may_be.alias("may"), f)

            return _bound(told, judged)

        return of

    def rewritten(pattern: str, instead: str):
        return lambda m: m.withField("text", F.regexp_replace(m["text"], pattern, instead))

    def unmarked(kind: str) -> list[Column]:
        """The confirmed base spans of a kind in each form without a mark that still has enough digits."""
        forms = {"email": [("@", " (at) ")], "phone": [(r"^\+", ""), (r"^\+[0-9]{1,3}[ .-]", "")]}.get(kind, [])
        out = []
        for pattern, instead in forms:
            spans = F.transform(f"b_{kind}", rewritten(pattern, instead))
            spans = F.filter(spans, lambda m: ~m["text"].startswith("+") & possible(kind, m["text"]))
            out.append(F.transform(spans, lambda m: F.struct(F.lit(KINDS.index(kind)).alias("kind"), _features(kind, m).withField("context", F.lit(0)).alias("f"))))
        return out

    base = F.concat(*(F.transform(f"b_{k}", placed(i)) for i, k in enumerate(KINDS)))
    wide = []
    for kind in KINDS:
        needs = F.col("text").rlike(r"@|[\[(](?:at|AT)[\])]") if kind == "email" else F.col("text").rlike(r"[0-9]")
        found = matches(F.col("text"), _WIDE[kind], needs, context=True)
        if kind == "phone":
            found = F.filter(found, lambda m: F.length(_digits(m["text"])).between(7, 15))
        if kind == "card":
            found = F.filter(found, lambda m: F.length(_digits(m["text"])).between(12, 19))
        wide.append(F.transform(found, described(KINDS.index(kind), kind)))
    return docs.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(5)).alias("fold"), F.array_sort(base).alias("base"), F.concat(*wide).alias("proposed"), F.concat(*(x for k in KINDS for x in unmarked(k))).alias("made"))


Tree = tuple[float, list[tuple[str, int, str, int, list[float]]]]


def boost(cells: list[tuple[dict[str, int], float, float]], rounds: int = 40, rate: float = 0.3, shrink: float = 5.0) -> Tree:
    """Boosted trees of depth two on (features, positives, negatives): the start value, and splits f <= t twice with four leaves."""
    names = list(FEATURES)
    x = np.array([[f[n] for n in names] for f, _, _ in cells], np.int64)
    pos, neg = (np.array([c[k] for c in cells], float) for k in (1, 2))
    start = math.log((pos.sum() + 1) / (neg.sum() + 1))
    raw = np.full(len(cells), start)
    trees = []

    def best(g: np.ndarray, h: np.ndarray, half: np.ndarray) -> tuple[int, int]:
        """The feature and cut of greatest gain, summed over the two halves given."""
        found = (-math.inf, 0, 0)
        for k, n in enumerate(FEATURES.values()):
            sums = [np.bincount(half * n + x[:, k], v, 2 * n).reshape(2, n) for v in (g, h)]
            low = [v.cumsum(1)[:, :-1] for v in sums]
            high = [v.sum(1, keepdims=True) - w for v, w in zip(sums, low, strict=True)]
            gain = sum(a * a / (b + shrink) for a, b in (low, high)).sum(0)
            t = int(gain.argmax())
            if gain[t] > found[0]:
                found = (float(gain[t]), k, t)
        return found[1:]

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(raw, -30, 30)))
        g, h = pos * (1 - p) - neg * p, (pos + neg) * p * (1 - p)
        f1, t1 = best(g, h, np.zeros(len(cells), np.int64))
        half = (x[:, f1] > t1).astype(np.int64)
        f2, t2 = best(g, h, half)
        leaf = 2 * half + (x[:, f2] > t2)
        leaves = rate * np.bincount(leaf, g, 4) / (np.bincount(leaf, h, 4) + shrink)
        trees.append((names[f1], t1, names[f2], t2, leaves.tolist()))
        raw += leaves[leaf]
    return start, trees


def tree_value(model: Tree, f: dict[str, int]) -> float:
    start, trees = model
    return start + sum(leaves[2 * (f[a] > s) + (f[b] > t)] for a, s, b, t, leaves in trees)


def _tree_column(model: Tree, f: Column) -> Column:
    start, trees = model
    total = F.lit(start)
    for a, s, b, t, leaves in trees:
        x, y = f[a] > s, f[b] > t
        total = total + F.when(x & y, leaves[3]).when(x, leaves[2]).when(y, leaves[1]).otherwise(leaves[0])
    return total


def fit_candidates(candidates: DataFrame, precision: float = 0.98) -> dict[str, tuple[Tree, float]]:
    """For each kind its trees and the least raw value that is selected. precision: wanted of the fold kept out (of five)."""
    held = (F.col("fold") == 0).alias("held")
    rows = candidates.select(held, F.explode("proposed").alias("c")).select("held", "c.kind", "c.f", "c.y", "c.met")
    rows = rows.union(candidates.select(held, F.explode("made").alias("c")).select("held", "c.kind", "c.f", F.lit(1), F.lit(False)))
    # Base spans stay anyway: what they meet trains, but the precision wanted is that of the rest.
    pos, neg = (F.count_if((F.col("y") == y) & ~(F.col("held") & F.col("met"))) for y in (1, 0))
    cells = rows.where("y is not null").groupBy("held", "kind", "f").agg(pos.alias("pos"), neg.alias("neg"))
    cells = cells.collect()  # one for each vector of feature values, kind and fold at most: FEATURES and KINDS bound them
    out = {}
    for k, kind in enumerate(KINDS):
        own = [(r.held, r.f.asDict(), float(r.pos), float(r.neg)) for r in cells if r.kind == k]
        train = sorted(((f, p, n) for held, f, p, n in own if not held), key=lambda c: tuple(c[0].values()))
        if not train or not any(p for _, p, _ in train):
            continue
        model = boost(train)
        scored = sorted(((tree_value(model, f), p, n) for held, f, p, n in own if held), key=lambda c: -c[0])
        threshold, good, bad = None, 0.0, 0.0
        for i, (value, p, n) in enumerate(scored):
            good, bad = good + p, bad + n
            if (i + 1 == len(scored) or scored[i + 1][0] < value) and good >= precision * (good + bad):
                threshold = value
        if threshold is not None:
            out[kind] = (model, threshold)
    return out


def find_personal_data(documents: DataFrame, precision: float = 0.98) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base and spans (arrays of start, kind, end; kind counts from 0 in KINDS)."""
    found = materialise(find_candidates(documents), "candidates")
    models = fit_candidates(found, precision)
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    added = none
    if models:
        def selected(c: Column) -> Column:
            test = F.lit(False)
            for kind, (model, threshold) in models.items():
                test = F.when(c["kind"] == KINDS.index(kind), _tree_column(model, c["f"]) >= threshold - 1e-9).otherwise(test)
            return test

        chosen = F.filter("proposed", lambda c: c["may"] & selected(c))
        added = F.transform(chosen, lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end")))
    spans = F.array_sort(F.concat("base", added))

    def of_kind(number: int):
        return lambda b: b["kind"] == number

    counts = [F.size(F.filter("base", of_kind(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select("doc_id", *counts, "base", spans.alias("spans"))


def span_text(spans: Column) -> Column:
    """kind:start:end, comma between."""
    name = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))))


def redact(text: Column, spans: Column, mark: str = "█") -> Column:
    """The text with each span's characters replaced by ``mark``."""
    step = lambda t, s: F.concat(F.substr(t, F.lit(1), s["start"]), F.repeat(F.lit(mark), s["end"] - s["start"]), F.substr(t, s["end"] + 1, F.length(t)))
    return F.aggregate(spans, text, step)
