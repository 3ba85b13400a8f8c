"""Personal data: base rules, and more spans chosen by gradient-boosted trees, in DataFrame operations.

High-recall generators propose spans with their format and context.  Boosted
trees, fitted by ``train`` on a bounded synthetic sample and turned into a
column expression, score each span; a calibrated threshold per kind selects
those to redact.  Spans of the base rules always stay.  Only texts that hold a
digit, an ``@`` or a spelt-out ``at`` are searched at all.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .names import unused

#: Kinds in the order of output; the first four have base rules.
KINDS = ("email", "ip", "card", "phone", "ssn", "iban", "secret")

#: Base rules.  Possessive parts and the look-behind change no match; they keep the search linear:
#: a match can only start where its first run of characters starts, or where the last match ended.
_LOCAL = "[A-Za-z0-9._%+-]"
BASE_RULES = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_IP_PARTS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.|$)){4}$"

#: Generators of further candidates, each a kind, a pattern and a text that must occur (or None).
GENERATORS = (
    ("email", r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]++\s?[\[(]at[\])]\s?[A-Za-z0-9-]++(?:\s?(?:[\[(]dot[\])]|\.)\s?[A-Za-z]{2,}+)++", "at"),
    ("card", r"(?<![0-9A-Za-z.+-])[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}(?![0-9A-Za-z])", None),
    ("phone", r"(?<![0-9A-Za-z.+(-])(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9A-Za-z])", None),
    ("ssn", r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])", "-"),
    ("iban", r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])", None),
    ("secret", r"(?<![0-9A-Za-z_/+-])(?=[A-Za-z_/+-]*+[0-9])[A-Za-z0-9_/+-]{20,}+(?![0-9A-Za-z_/+-])", None),
)

#: Characters of context on the left of a candidate.
CONTEXT = 40
#: Fixed words that often precede personal data, or numbers that are none.
CONTEXT_WORDS = {
    "says_phone": "(?i)phone|tel\\b|tel[.:]|call|mobile|fax|whatsapp|contact",
    "says_card": "(?i)card|visa|credit|debit|payment|amex",
    "says_id": "(?i)ssn|social security|iban|account|passport",
    "says_secret": "(?i)token|secret|api|key|passw|auth|bearer|credential",
    "says_mail": "(?i)mail|contact|write to|reach",
    "says_other": "(?i)order|invoice|isbn|version|ref\\b|item|serial|sha|commit|hash|page|total|number of|doi|build",
}
FEATURES = ("kind", "length", "digits", "letters", "upper", "marks", "distinct", "luhn", "quoted", "hex", *CONTEXT_WORDS)


# Expressions are put together as SQL text and parsed once: built call by call, these would
# take tens of thousands of round trips to the JVM.  Values passed along are SQL themselves.


def forget_parses(spark: SparkSession) -> None:
    """Drops the tables that Spark's parser keeps of what it has read: after texts as long as these, some 50 MB of the driver's heap.

    Later parses fill them anew as far as they need them; no result depends on them.
    """
    spark._jvm.org.apache.spark.sql.catalyst.parser.SqlBaseParser(None).getInterpreter().clearDFA()


def _quoted(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(value: str, name: str, body: str) -> str:
    """``body`` with a value of this name that is computed once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _digits(value: str) -> str:
    return f"regexp_replace({value}, '[^0-9]', '')"


def luhn(digits: str) -> str:
    """Whether a string of digits passes the check sum (short strings only: it is walked by character)."""
    digit = "cast(try_to_number(substr(ds, i, 1), '9') AS int)"
    doubled = f"CASE WHEN {digit} > 4 THEN {digit} * 2 - 9 ELSE {digit} * 2 END"
    total = f"aggregate(sequence(1, greatest(length(ds), 1)), 0, (acc, i) -> acc + coalesce(CASE WHEN (length(ds) - i) % 2 = 1 THEN {doubled} ELSE {digit} END, 0))"
    return _let(digits, "ds", f"length(ds) > 0 AND {total} % 10 = 0")


#: Elements that one step of a scan holds: an array that grows is copied at each append.
SCAN_BLOCK = 64


def _blocks(items: str) -> str:
    """The array cut into arrays of SCAN_BLOCK elements."""
    return _let(items, "own", f"transform(sequence(0, cast(floor((size(own) - 1) / {SCAN_BLOCK}) AS int)), b -> slice(own, b * {SCAN_BLOCK} + 1, {SCAN_BLOCK}))")


def _scanned(items: str, zero: str, value: str, join: Callable[[str, str], str], out: str, kind: str) -> str:
    """``out``, of ``before`` and x, for each x, where ``before`` joins ``zero`` and the ``value`` (of x) of all elements ahead.

    Blocks are summed first, so the work is that of n * (SCAN_BLOCK + n / SCAN_BLOCK**2) copies, not n * n.
    """

    def walk(over: str, start: str, of: str, made: str, made_kind: str) -> str:
        made = _let("acc.at", "before", made)
        step = f"named_struct('at', {join('acc.at', of)}, 'out', array_append(acc.out, {made}))"
        return f"aggregate({over}, named_struct('at', {start}, 'out', cast(array() AS array<{made_kind}>)), (acc, x) -> {step}).out"

    totals = f"transform(blocks, block -> aggregate(block, {zero}, (acc, x) -> {join('acc', value)}))"
    starts = walk(totals, zero, "x", "before", "int")
    whole = f"flatten(zip_with(blocks, {starts}, (block, since) -> {walk('block', 'since', value, out, kind)}))"
    return _let(_blocks(items), "blocks", whole)


def _located(text: str, pattern: str) -> str:
    """[(start, end, value, left)] of the leftmost non-overlapping matches, in code points, end exclusive; null if there are none.

    ``left`` is what stands between the match before and this one, CONTEXT characters of it.
    """
    pattern = _quoted(pattern)
    sized = f"named_struct('value', value, 'skip', length(gap), 'size', length(value), 'left', right(gap, {CONTEXT}))"
    pairs = f"zip_with(hits, slice(split({text}, {pattern}, -1), 1, size(hits)), (value, gap) -> {sized})"
    placed = "named_struct('start', before + x.skip, 'end', before + x.skip + x.size, 'value', x.value, 'left', x.`left`)"
    found = _scanned(pairs, "0", "x.skip + x.size", lambda a, b: f"{a} + ({b})", placed, "struct<start:int,end:int,value:string,left:string>")
    return _let(f"regexp_extract_all({text}, {pattern}, 0)", "hits", f"CASE WHEN size(hits) > 0 THEN {found} END")


def _valid(kind: str, value: str) -> str:
    n = f"length({_digits(value)})"
    if kind == "ip":
        return f"regexp_like({value}, {_quoted(_IP_PARTS)})"
    if kind == "card":
        return f"CASE WHEN {n} BETWEEN 12 AND 19 THEN {luhn(_digits(value))} ELSE false END"
    if kind == "phone":
        return f"{n} BETWEEN 9 AND 15"
    return "true"


def _features(kind: int) -> str:
    """FEATURES of a candidate x of this kind."""

    def count(pattern: str) -> str:
        return f"length(x.value) - length(regexp_replace(x.value, {_quoted(pattern)}, ''))"

    def says(pattern: str) -> str:
        return f"regexp_like(x.`left`, {_quoted(pattern)})"

    fields = {
        "kind": str(kind), "length": "length(x.value)", "digits": f"length({_digits('x.value')})", "letters": count("[A-Za-z]"), "upper": count("[A-Z]"), "marks": count("[^A-Za-z0-9]"),
        "distinct": "size(array_distinct(split(substr(x.value, 1, 64), '')))", "luhn": f"cast({_valid('card', 'x.value')} AS int)",
        "quoted": f"cast({says('["' + "'" + '=:]' + chr(92) + 's*$')} AS int)", "hex": "cast(regexp_like(x.value, '^[0-9a-f]+$') AS int)",
    } | {name: f"cast({says(pattern)} AS int)" for name, pattern in CONTEXT_WORDS.items()}
    return f"array({', '.join(f'cast({fields[name]} AS double)' for name in FEATURES)})"


def _searchable(text: str) -> str:
    return f"coalesce(regexp_like({text}, '[0-9]') OR contains({text}, '@') OR contains({text}, '[at]') OR contains({text}, '(at)'), false)"


def _whole(spans: str, text: str, needed: str | None, kind: str) -> str:
    """``spans``, or none where the text lacks what they need."""
    some = f"CASE WHEN contains({text}, {_quoted(needed)}) THEN {spans} END" if needed else spans
    return f"coalesce(cast({some} AS {kind}), cast(array() AS {kind}))"


def _base(text: str) -> str:
    """Base spans [(start, kind number, end)] unordered."""
    needed, parts = {"email": "@", "phone": "+"}, []
    for number, kind in enumerate(KINDS[:4]):
        found = f"filter({_located(text, BASE_RULES[kind])}, x -> {_valid(kind, 'x.value')})"
        spans = f"transform({found}, x -> named_struct('start', x.start, 'kind', {number}, 'end', x.`end`))"
        parts.append(_whole(spans, text, needed.get(kind), "array<struct<start:int,kind:int,end:int>>"))
    return f"concat({', '.join(parts)})"


def _candidates(text: str) -> str:
    """Candidate spans [(start, kind, end, features)] of all generators."""
    parts = []
    for kind, pattern, needed in GENERATORS:
        number = KINDS.index(kind)
        spans = f"transform({_located(text, pattern)}, x -> named_struct('start', x.start, 'kind', {number}, 'end', x.`end`, 'features', {_features(number)}))"
        parts.append(_whole(spans, text, needed, "array<struct<start:int,kind:int,end:int,features:array<double>>>"))
    return f"concat({', '.join(parts)})"


@dataclass(frozen=True)
class Boosted:
    """Trees as nested tuples (feature, cut, below, above) with leaf values, and a threshold per kind."""

    start: float
    trees: tuple
    thresholds: tuple[float, ...]

    def scores(self, x: np.ndarray) -> np.ndarray:
        def walk(tree, rows):
            if not isinstance(tree, tuple):
                return np.full(len(rows), tree)
            out, below = np.empty(len(rows)), rows[:, tree[0]] <= tree[1]
            out[below], out[~below] = walk(tree[2], rows[below]), walk(tree[3], rows[~below])
            return out

        return self.start + sum(walk(t, x) for t in self.trees)

    def sql(self, features: str) -> str:
        """The score as SQL over an array of features."""

        def walk(tree):
            if not isinstance(tree, tuple):
                return f"{float(tree)!r}D"
            return f"CASE WHEN {features}[{int(tree[0])}] <= {float(tree[1])!r}D THEN {walk(tree[2])} ELSE {walk(tree[3])} END"

        return " + ".join([f"{float(self.start)!r}D", *map(walk, self.trees)])


def boost(x: np.ndarray, y: np.ndarray, *, rounds: int = 16, depth: int = 3, rate: float = 0.3, least: int = 12) -> tuple[float, tuple]:
    """Start value and trees of logistic gradient boosting with Newton leaves, deterministic."""
    start = math.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    score, trees = np.full(len(y), start), []
    cuts = [np.unique(x[:, f])[:-1] if len(np.unique(x[:, f])) <= 16 else np.unique(np.quantile(x[:, f], np.linspace(0.03, 0.97, 16))) for f in range(x.shape[1])]

    def grow(rows, g, h, left):
        value = rate * g[rows].sum() / (h[rows].sum() + 1.0)
        best = (1e-6, None, None)
        base = g[rows].sum() ** 2 / (h[rows].sum() + 1.0)
        if left and len(rows) >= 2 * least:
            for f, options in enumerate(cuts):
                for cut in options:
                    side = x[rows, f] <= cut
                    n = int(side.sum())
                    if least <= n <= len(rows) - least:
                        a, b = rows[side], rows[~side]
                        gain = g[a].sum() ** 2 / (h[a].sum() + 1.0) + g[b].sum() ** 2 / (h[b].sum() + 1.0) - base
                        if gain > best[0]:
                            best = (gain, f, cut)
        if best[1] is None:
            score[rows] += value
            return float(value)
        side = x[rows, best[1]] <= best[2]
        return (best[1], float(best[2]), grow(rows[side], g, h, left - 1), grow(rows[~side], g, h, left - 1))

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        trees.append(grow(np.arange(len(y)), y - p, p * (1 - p), depth))
    return start, tuple(trees)


def synthetic(n: int = 1600, seed: int = 11) -> list[tuple[str, int]]:
    """Sentences with one span each and whether it is personal data; ``n`` bounds the training sample."""
    r = random.Random(seed)
    words = "the station report was sent after review and then filed under notes for later use by our team in spring".split()

    def pick(pattern: str) -> str:
        tables = {"9": "0123456789", "a": "abcdefghijklmnopqrstuvwxyz", "A": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "h": "0123456789abcdef", "x": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"}
        return "".join(r.choice(tables[c]) if c in tables else c for c in pattern)

    def card(ok: bool) -> str:
        digits = pick("4999" + "9" * 11)
        total = sum((lambda d: d * 2 - 9 if d > 4 else d * 2)(int(c)) if i % 2 == 0 else int(c) for i, c in enumerate(digits))
        last = (10 - total % 10) % 10
        whole = digits + str(last if ok else (last + r.randint(1, 9)) % 10)
        joint = r.choice(["", " ", "-"])
        return joint.join(whole[i : i + 4] for i in range(0, 16, 4))

    good = [
        (lambda: f"{pick('aaaaa')} {r.choice('[(')}at] {pick('aaaaaa')} [dot] com".replace("(at]", "(at)"), ["write to ", "mail: ", "", "contact "]),
        (lambda: card(True), ["card ", "visa ", "payment by ", ""]),
        (lambda: card(False), ["credit card ", "card number: "]),
        (lambda: pick(r.choice(["(999) 999-9999", "999-999-9999", "999.999.9999"])), ["call ", "tel: ", "phone ", "mobile ", "fax ", "contact "]),
        (lambda: pick("999-99-9999"), ["SSN ", "social security ", ""]),
        (lambda: pick(r.choice(["AA99 9999 9999 9999 9999 99", "AA99AAAA99999999999999"])), ["IBAN ", "account ", ""]),
        (lambda: pick(r.choice(["h" * 40, "h" * 32, "x" * 40, "x" * 24 + "9"])), ['token = "', "api_key: ", "secret=", "password: ", 'key = "', "bearer "]),
    ]
    bad = [
        (lambda: card(False), ["order ", "serial ", "item ", "", "total "]),
        (lambda: pick("9999 9999 9999 9999"), ["number of ", "page ", "invoice ", ""]),
        (lambda: pick(r.choice(["999-999-9999", "99 999 9999", "999 999 9999"])), ["order ", "ref ", "version ", "isbn ", "", "total "]),
        (lambda: pick("999-99-9999"), ["order ", "serial ", "item ", "invoice "]),
        (lambda: pick("AA99 9999 9999 9999 9999"), ["serial ", "item ", "build "]),
        (lambda: pick(r.choice(["h" * 40, "h" * 64, "x" * 30 + "9"])), ["commit ", "sha256 ", "hash of ", "build ", ""]),
        (lambda: "-".join(r.choice(words) for _ in range(5)) + pick("-9999"), ["see ", "page ", ""]),
    ]
    out = []
    for i in range(n):
        make, before = r.choice(good if i % 2 else bad)
        lead, tail = " ".join(r.choices(words, k=7)), " ".join(r.choices(words, k=4))
        out.append((f"{lead} {r.choice(before)}{make()} {tail}", i % 2))
    return out


_models: dict[tuple[int, int, float], Boosted] = {}


def train(spark: SparkSession, *, n: int = 1600, seed: int = 11, precision: float = 0.97) -> Boosted:
    """Trees and thresholds from ``n`` synthetic sentences, a quarter of them held out.

    A kind's threshold is the least score that reaches ``precision`` on the held-out
    part (and 0 at least).  The same arguments give the same model, kept per process.
    """
    if (n, seed, precision) not in _models:
        rows = spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(synthetic(n, seed))], "i int, text string, y int")
        found = rows.select("i", "y", F.explode(F.expr(_candidates("text"))).alias("c")).select("i", "y", "c.kind", "c.features").orderBy("i", "c.start").collect()
        forget_parses(spark)
        x, y, kind, held = np.array([r.features for r in found]), np.array([r.y for r in found], float), np.array([r.kind for r in found]), np.array([r.i % 8 in (2, 3) for r in found])
        start, trees = boost(x[~held], y[~held])
        model = Boosted(start, trees, (0.0,) * len(KINDS))
        scores, thresholds = model.scores(x), []
        for k in range(len(KINDS)):
            own = np.sort(scores[held & (kind == k)])
            fits = [s for s in own if s > 0 and y[held & (kind == k) & (scores >= s)].mean() >= precision]
            thresholds.append(float(min(fits)) - 1e-6 if fits else 1e9 if len(own) else 0.0)
        _models[n, seed, precision] = Boosted(start, trees, tuple(thresholds))
    return _models[n, seed, precision]


_SPAN = "struct<start:int,kind:int,end:int,base:boolean>"


def _beside(spans: str) -> str:
    """Chosen spans that overlap no base span, from all spans in order; two scans, one each way.

    Of the base spans ahead the last end counts, of those behind the first start.
    """
    never, kind = str(2**31 - 1), _SPAN[:-1] + ",free:boolean>"

    def freed(free: str) -> str:
        return f"named_struct('start', x.start, 'kind', x.kind, 'end', x.`end`, 'base', x.base, 'free', {free})"

    ahead = _scanned(spans, "0", "CASE WHEN x.base THEN x.`end` ELSE 0 END", lambda a, b: f"greatest({a}, {b})", freed("before <= x.start"), kind)
    behind = _scanned(f"reverse({ahead})", never, f"CASE WHEN x.base THEN x.start ELSE {never} END", lambda a, b: f"least({a}, {b})", freed("x.free AND before >= x.`end`"), kind)
    return f"transform(filter(reverse({behind}), x -> x.base OR x.free), x -> named_struct('start', x.start, 'kind', x.kind, 'end', x.`end`, 'base', x.base))"


def find(docs: DataFrame, model: Boosted, *, text: str = "text", spans: str = "pii_spans") -> DataFrame:
    """``docs`` plus ``spans``: [(start, kind, end, base)] by start, then kind number.

    ``kind`` indexes KINDS; offsets are code points, end exclusive; ``base`` tells
    spans of the base rules, which are all there.  A span chosen by the model
    overlaps no base span.  Null, empty and other texts give an empty array; rows
    do not depend on each other, so repeated rows get equal spans and an empty table
    none; no shuffle; a column named like ``spans`` is replaced, others pass through
    whatever their names.  Memory is a small multiple of a text and its matches.
    """
    kept = docs.select(*[docs[f"`{c}`"] for c in docs.columns if c != spans])
    held, own = unused("pii", docs.columns), f"`{text}`"
    names = [F.col(f"`{c}`") for c in kept.columns]
    searched = kept.select(*names, F.expr(f"CASE WHEN {_searchable(own)} THEN named_struct('base', {_base(own)}, 'more', {_candidates(own)}) END").alias(held))

    def marked(array: str, base: str) -> str:
        return f"transform({array}, x -> named_struct('start', x.start, 'kind', x.kind, 'end', x.`end`, 'base', {base}))"

    limits = f"array({', '.join(f'{float(t)!r}D' for t in model.thresholds)})"
    chosen = f"filter(`{held}`.more, x -> {model.sql('x.features')} >= {limits}[x.kind])"
    both = unused("spans", [*docs.columns, held])
    # equal spans stand side by side: a distinct of structs would compare all with all
    every = _let(f"sort_array(concat({marked(f'`{held}`.base', 'true')}, {marked(chosen, 'false')}))", "own", "filter(own, (x, i) -> coalesce(x <> get(own, i - 1), true))")
    searched = searched.select(*names, F.expr(f"CASE WHEN `{held}` IS NOT NULL THEN {every} END").alias(both), F.expr(f"size(`{held}`.base) > 0").alias(held))
    # without base spans, or without others, nothing can overlap
    found = f"CASE WHEN size(`{both}`) > 0 THEN CASE WHEN `{held}` AND exists(`{both}`, x -> NOT x.base) THEN {_beside(f'`{both}`')} ELSE `{both}` END END"
    searched = searched.select(*names, F.expr(f"cast(coalesce({found}, cast(array() AS array<{_SPAN}>)) AS array<{_SPAN}>)").alias(spans))
    forget_parses(docs.sparkSession)
    return searched


def listed(spans: Column) -> Column:
    """``kind:start:end`` of the spans, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", names[x["kind"]], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by ``[KIND]``; overlapping spans become one, named by the first.

    ``spans`` are in order of start.  A block of spans takes its stretch of the
    text once, and each span of it a part of that stretch.
    """
    names = f"array({', '.join(_quoted(f'[{k.upper()}]') for k in KINDS)})"
    kind = "struct<after:int,start:int,kind:int,end:int>"
    placed = _scanned("o.spans", "0", "x.`end`", lambda a, b: f"greatest({a}, {b})", "named_struct('after', before, 'start', x.start, 'kind', x.kind, 'end', x.`end`)", kind)
    since, to = "get(block, 0).after", "greatest(element_at(block, -1).start, element_at(block, -1).after)"
    stretch = f"named_struct('text', substr(o.text, {since} + 1, {to} - {since}), 'since', {since})"
    named = f"CASE WHEN x.start >= x.after THEN concat(substr(part.text, x.after - part.since + 1, x.start - x.after), {names}[x.kind]) ELSE '' END"
    stretches = f"transform({_blocks(placed)}, block -> array_join({_let(stretch, 'part', f'transform(block, x -> {named})')}, ''))"
    last = "array_max(transform(o.spans, x -> x.`end`))"
    body = F.expr(f"o -> CASE WHEN size(o.spans) > 0 THEN concat(array_join({stretches}, ''), substr(o.text, {last} + 1)) ELSE o.text END")
    return F.get(F.call_function("transform", F.array(F.struct(text.alias("text"), spans.alias("spans"))), body), F.lit(0))
