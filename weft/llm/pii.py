"""Personal data: base patterns, and a semi-Markov conditional random field that adds spans.

The field scores whole segments: a candidate is a span of up to LONGEST tokens with a type, and its
features (how many digits, how they are grouped, check sums, what stands at its edges) look at all of it
at once. Dynamic programming over segments chooses boundaries and types together; a segment's length is
bounded, so a region's cost is linear in its tokens. A span is added if its marginal probability is at
least ADD_FROM and it meets no base span; base spans always stay.

Only regions around digits, at-signs and bracketed "at"s are looked at, since no candidate lies
elsewhere; every such region of the whole text is, by windows of tokens: only sums and the best way to each
token are kept, candidates are made again for the way back. The weights are trained on the driver by
gradient ascent on the likelihood, on generated examples and on a bounded sample of documents labelled by
the base patterns.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import OWN, table, text_or_empty, without
from weft.runtime import bound_batches

KINDS = ("email", "ip", "card", "phone")
#: Tokens of a segment at most, marginal probability from which a span is added, tokens whose candidates are held at a time.
LONGEST, ADD_FROM, WINDOW = 28, 0.8, 4096
#: Documents in training at most, and bytes of each of them at most: no longer one is drawn.
SAMPLE, SAMPLE_BYTES = 200, 1 << 16
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a run of digits is tried from its begin only: its later digits lead to the same end
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile("[0-9]+")

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The base patterns' matches (start, end, kind) of a whole text, by start, then kind as in KINDS."""
    found: list[Span] = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            done = match.end()
            found.append((start, done, "email"))
        at = text.find("@", max(at + 1, done))
    if _DIGITS.search(text):
        for m in _IP.finditer(text):
            if all(len(p := x.lstrip("0")) < 4 and int(p or "0") <= 255 for x in m[0].split(".")):
                found.append((*m.span(), "ip"))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((*m.span(), "card"))
        for m in _PHONE.finditer(text):
            if 10 <= sum(map(len, _DIGITS.findall(m[0]))) <= 15:
                found.append((*m.span(), "phone"))
    return sorted(found, key=_order)


def _order(s: Span) -> tuple:
    return s[0], KINDS.index(s[2]), s[1]


# --- the field ---------------------------------------------------------------------------------

_ANCHOR = re.compile(r"[0-9@]|[(\[]at[)\]]")
_MARK = re.compile(r"[(\[]at[)\]]")
_TOKEN = re.compile(r"[(\[]at[)\]]|[A-Za-z]+|[0-9]+|[^A-Za-z0-9]")
#: Characters between anchors of one region.
GAP = 12
_SEPARATORS = frozenset(" -.()")
_MAIL = frozenset("._%+-")
FEATURES = (
    "mail", "mail_marked", "mail_dots", "quad", "quad_wide", "luhn", "card_length", "card_groups", "plain_run", "plus", "zeros", "paren", "digits_7_9",
    "digits_10_12", "digits_13_15", "digits_16_19", "digits_more", "one_group", "two_groups", "many_groups", "spaces", "dashes", "dots", "short_groups",
    "alnum_before", "alnum_after", "sep_before", "sep_after", "double_sep", "date", "first_group_wide", "goes_on", "zeros_grouped", "bias",
)
_AT = {f: i for i, f in enumerate(FEATURES)}
_DATE = re.compile(r"(?:19|20)[0-9]{2}[-./][0-9]{1,2}[-./][0-9]{1,2}|[0-9]{1,2}[-./][0-9]{1,2}[-./](?:19|20)[0-9]{2}")


def regions(text: str) -> list[tuple[int, int]]:
    """The stretches of text in which a candidate can lie: anchors close to each other, and the words around."""
    out: list[tuple[int, int]] = []
    for m in _ANCHOR.finditer(text):
        if out and m.start() - out[-1][1] <= GAP:
            out[-1] = (out[-1][0], m.end())
        else:
            out.append(m.span())
    wide: list[tuple[int, int]] = []
    for start, end in out:
        done = wide[-1][1] if wide else 0
        if end <= done:
            continue
        for _ in range(2):  # a bracketed "at" may stand apart; then the words beside it belong to it
            while start > done and not text[start - 1].isspace():
                start -= 1
            while end < len(text) and not text[end].isspace():
                end += 1
            start -= start > done and text[start - 1] == " " and bool(_MARK.match(text, start))
            end += end < len(text) and text[end] == " " and bool(_MARK.match(text, max(start, end - 4)))
        if wide and start <= done:
            wide[-1] = (wide[-1][0], end)
        else:
            wide.append((start, end))
    return wide


def _features(span: str, groups: list[str], before: str, after: str, mail: bool) -> list[int]:
    on = ["bias"]
    if before.isalnum():
        on.append("alnum_before")
    if len(after) > 1 and after[0] in " .-" and after[1].isalnum() and (after[1].isdigit() or mail and after[0] != " "):
        on.append("goes_on")
    after = after[:1]
    if after.isalnum():
        on.append("alnum_after")
    if before in "-.@+_/=\"'" and before:
        on.append("sep_before")
    if after in "-@_/=\"'" and after:
        on.append("sep_after")
    if mail:
        mark = re.search(r"\s?[(\[]at[)\]]\s?|@", span)
        local, domain = span[: mark.start()], span[mark.end() :]
        on.append("mail")
        if mark[0] != "@":
            on.append("mail_marked")
        if local and local[-1].isalnum() and re.fullmatch(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", domain):
            on.append("mail_dots")
        return [_AT[x] for x in on]
    digits = "".join(groups)
    n = len(digits)
    if len(groups) == 4 and re.fullmatch(r"[0-9]+(?:\.[0-9]+){3}", span):
        on.append("quad" if all(len(g) < 4 and int(g) <= 255 for g in groups) else "quad_wide")
    if 14 <= n <= 19:
        on.append("card_length")
        if luhn(digits):
            on.append("luhn")
        if [len(g) for g in groups][:3] in ([4, 4, 4], [4, 6, 5], [4, 6, 4]):
            on.append("card_groups")
    if digits == span:
        on.append("plain_run")
    if span[0] == "+":
        on.append("plus")
    if digits.startswith("00") and groups[0].startswith("00"):
        on.append("zeros")
        if len(groups) > 2 and min(map(len, groups)) > 1:
            on.append("zeros_grouped")
    if "(" in span and span.find(")") > span.find("("):
        on.append("paren")
    on.append("digits_7_9" if n < 10 else "digits_10_12" if n < 13 else "digits_13_15" if n < 16 else "digits_16_19" if n < 20 else "digits_more")
    on.append("one_group" if len(groups) == 1 else "two_groups" if len(groups) == 2 else "many_groups")
    on += [name for mark, name in ((" ", "spaces"), ("-", "dashes"), (".", "dots")) if mark in span]
    if min(map(len, groups)) == 1 and len(groups) > 3:
        on.append("short_groups")
    if re.search(r"[ .-][ .-]", span):
        on.append("double_sep")
    if _DATE.search(span):
        on.append("date")
    if len(groups[0]) > 5:
        on.append("first_group_wide")
    return [_AT[x] for x in on]


class Region:
    """A region's tokens and, by the token that it begins with, its candidate segments, which meet none of blocked."""

    def __init__(self, text: str, start: int, end: int, blocked: list[Span] = ()):
        self.text = text
        self.tokens = _TOKEN.findall(text, start, end)
        self.offsets = array("q", accumulate(map(len, self.tokens), initial=start))
        self.blocked = bytearray(len(self.tokens))
        for a, b, _ in blocked:
            low, high = bisect_right(self.offsets, a) - 1, bisect_left(self.offsets, b)
            for i in range(max(low, 0), min(high, len(self.tokens))):
                self.blocked[i] = 1

    def candidates(self, i: int) -> Iterator[tuple[int, tuple[int, ...], list[int]]]:
        """End token, kinds and features of each candidate that begins with token i."""
        text, tokens, offsets = self.text, self.tokens, self.offsets
        first = tokens[i]
        if not (first[0].isdigit() and first.isascii() or first in "+(" or first[0].isalpha() and first.isascii()):
            return
        numeric, mail, marks, digits = True, True, 0, []
        for j in range(i, min(len(tokens), i + LONGEST)):
            t = tokens[j]
            is_digits, is_mark = t.isascii() and t.isdigit(), t == "@" or len(t) == 4 and t[0] in "(["
            if is_digits:
                digits.append(t)
            numeric = numeric and (is_digits or t in _SEPARATORS or (t == "+" and j == i))
            marks += is_mark
            spaced = t == " " and (j + 1 < len(tokens) and len(tokens[j + 1]) == 4 and tokens[j + 1][0] in "([" or j > i and len(tokens[j - 1]) == 4 and tokens[j - 1][0] in "([")
            mail = mail and (t.isascii() and t.isalnum() or t in _MAIL or is_mark or spaced) and marks <= 1
            if not (numeric or mail) or self.blocked[j]:
                return
            if t in _SEPARATORS or t == "+" or is_mark:
                continue
            a, b = offsets[i], offsets[j + 1]
            before, after = text[a - 1 : a], text[b : b + 2]
            if numeric and (sum(map(len, digits)) >= 7 or len(digits) == 4 and text[a:b].count(".") == 3):
                yield j + 1, (1, 2, 3), _features(text[a:b], digits, before, after, False)
            elif mail and marks and first not in "+(" and "." in tokens[i:j]:
                yield j + 1, (0,), _features(text[a:b], digits, before, after, True)


@dataclass
class Lattice:
    """A whole region's candidate segments: begin and end token, type, features. For training, whose texts are short."""

    n: int
    offsets: array
    begin: np.ndarray
    end: np.ndarray
    kind: np.ndarray
    features: np.ndarray


def lattice(text: str, start: int, end: int, blocked: list[Span] = ()) -> Lattice:
    """The candidates in text[start:end] that meet none of blocked."""
    region = Region(text, start, end, blocked)
    rows = [(i, j, k, own) for i in range(len(region.tokens)) for j, kinds, own in region.candidates(i) for k in kinds]
    rows.sort(key=lambda r: r[1])
    x = np.zeros((len(rows), len(FEATURES)))
    for r, row in enumerate(rows):
        x[r, row[3]] = 1
    return Lattice(len(region.tokens), region.offsets, *(np.array([r[c] for r in rows], np.int64) for c in range(3)), x)


def _plus(x: float, y: float) -> float:
    """log(exp(x) + exp(y))."""
    low, high = (x, y) if x < y else (y, x)
    return high if low == -math.inf else high + math.log1p(math.exp(low - high))


def decode(region: Region, weights: np.ndarray) -> list[tuple[int, int, int, float]]:
    """Begin and end token, kind and marginal probability of the segments of the best segmentation.

    Ties go to fewer and earlier segments. The candidates of WINDOW tokens are held at a time; beside them a token
    costs some numbers, so a region may be as long as its text.
    """
    n, rows = len(region.tokens), [row.tolist() for row in weights]
    held: dict[int, list] = {}

    def scored(i: int) -> list[tuple[int, int, float]]:
        window = i // WINDOW
        if window not in held:
            held.clear()
            held[window] = [[(j, k, sum([rows[k][x] for x in own])) for j, kinds, own in region.candidates(t) for k in kinds] for t in range(window * WINDOW, min(n, (window + 1) * WINDOW))]
        return held[window][i % WINDOW]

    forward, value = array("d", [-math.inf]) * (n + 1), array("d", [-math.inf]) * (n + 1)
    origin, kind, gain = array("q", [-1]) * (n + 1), array("b", [-1]) * (n + 1), array("d", [0.0]) * (n + 1)
    forward[0] = value[0] = 0.0
    for i in range(n + 1):
        if i:
            forward[i] = _plus(forward[i], forward[i - 1])
            if value[i] <= value[i - 1] + 1e-12:
                value[i], origin[i] = value[i - 1], -1
        if i < n:
            for j, k, score in scored(i):
                forward[j] = _plus(forward[j], forward[i] + score)
                if value[i] + score > value[j] + 1e-12:
                    value[j], origin[j], kind[j], gain[j] = value[i] + score, i, k, score
    picked, j = [], n
    while j:
        if origin[j] < 0:
            j -= 1
        else:
            picked.append((origin[j], j, kind[j], gain[j]))
            j = origin[j]
    if not picked:
        return []
    backward = array("d", [-math.inf]) * (n + 1)
    backward[n] = 0.0
    for i in range(n - 1, -1, -1):
        total = backward[i + 1]
        for j, _, score in scored(i):
            total = _plus(total, backward[j] + score)
        backward[i] = total
    return [(i, j, k, math.exp(forward[i] + score + backward[j] - forward[n])) for i, j, k, score in picked[::-1]]


def marginals(lat: Lattice, weights: np.ndarray) -> tuple[np.ndarray, float]:
    """The probability of each candidate, and the log partition function; a token outside scores 0."""
    score = np.einsum("ij,ij->i", lat.features, weights[lat.kind]) if len(lat.kind) else np.zeros(0)
    forward = np.full(lat.n + 1, -np.inf)
    backward = np.full(lat.n + 1, -np.inf)
    forward[0] = backward[lat.n] = 0.0
    cut = np.searchsorted(lat.end, np.arange(lat.n + 2))
    for j in range(1, lat.n + 1):
        own = slice(cut[j], cut[j + 1])
        forward[j] = forward[j - 1] if cut[j] == cut[j + 1] else np.logaddexp(forward[j - 1], np.logaddexp.reduce(forward[lat.begin[own]] + score[own]))
    by_begin = np.argsort(lat.begin, kind="stable")
    begins = lat.begin[by_begin]
    cut = np.searchsorted(begins, np.arange(lat.n + 2))
    for i in range(lat.n - 1, -1, -1):
        own = by_begin[cut[i] : cut[i + 1]]
        backward[i] = backward[i + 1] if not len(own) else np.logaddexp(backward[i + 1], np.logaddexp.reduce(backward[lat.end[own]] + score[own]))
    total = forward[lat.n]
    return np.exp(forward[lat.begin] + score + backward[lat.end] - total), float(total)


def fit(examples: list[tuple[str, list[Span]]], epochs: int = 30, rate: float = 0.5, ridge: float = 0.02) -> np.ndarray:
    """Weights (a row a kind) that make the spans of the examples likely."""
    data = []
    for text, spans in examples:
        for start, end in regions(text):
            lat = lattice(text, start, end)
            if len(lat.kind):
                gold, done = np.zeros(len(lat.kind)), -1
                at = {(lat.offsets[b], lat.offsets[e], k): r for r, (b, e, k) in enumerate(zip(lat.begin, lat.end, lat.kind, strict=True))}
                for a, b, kind in spans:
                    if a >= done and (r := at.get((a, b, KINDS.index(kind)))) is not None:
                        gold[r], done = 1, b
                data.append((lat, gold))
    weights = np.zeros((len(KINDS), len(FEATURES)))
    weights[:, _AT["bias"]] = -2.0
    square = np.full_like(weights, 1e-6)
    for _ in range(epochs):
        for first in range(0, len(data), 16):
            step = np.zeros_like(weights)
            for lat, gold in data[first : first + 16]:
                np.add.at(step, lat.kind, (gold - marginals(lat, weights)[0])[:, None] * lat.features)
            step -= ridge * weights
            square += step**2
            weights += rate * step / np.sqrt(square)
    return weights


def generated(n: int = 960, seed: int = 11) -> list[tuple[str, list[Span]]]:
    """Examples with known spans: every kind in plain and in disguised forms, and numbers that are none."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randint(2, 8)))
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))

    def card() -> str:
        body = r.choice("3456") + digits(r.choice((13, 14, 14, 14)))
        whole = next(body + d for d in "0123456789" if luhn(body + d))
        return whole if r.random() < 0.5 else r.choice(" -").join(whole[i : i + 4] for i in range(0, len(whole), 4))

    def phone() -> str:
        sep = r.choice((" ", "-", " ", "."))
        head = r.choice(("+", "+", "00")) + str(r.randint(1, 99))
        area = digits(r.randint(2, 4))
        return sep.join([head, f"({area})" if r.random() < 0.3 else area, digits(r.randint(3, 4)), digits(r.randint(3, 4))])

    def mail() -> str:
        mark = r.choice(("@", "@", "(at)", "[at]", " (at) ", " [at] "))
        return f"{word()}{r.choice(('.', '_', ''))}{r.choice((word(), digits(2)))}{mark}{word()}.{r.choice(('com', 'org', 'example.net', 'de'))}"

    makers = {"email": mail, "ip": lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)), "card": card, "phone": phone}
    nothing = (
        lambda: digits(r.randint(1, 20)), lambda: f"{r.randint(1900, 2099)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}", lambda: f"{digits(3)}.{digits(2)}",
        lambda: "".join(r.choice("0123456789abcdef") for _ in range(40)), lambda: f"{r.randint(300, 999)}.{r.randint(0, 999)}.{r.randint(0, 999)}.{r.randint(256, 999)}",
        lambda: f"{word()}-{digits(9)}-{digits(3)}", lambda: " ".join(digits(r.randint(1, 4)) for _ in range(r.randint(3, 9))), lambda: f"978-{digits(1)}-{digits(4)}-{digits(4)}-{digits(1)}",
        lambda: f"v{r.randint(0, 9)}.{digits(1)}.{digits(2)}", lambda: f"{digits(3)},{digits(3)},{digits(3)}", lambda: f"{digits(4)}-{digits(4)}", lambda: f"@{word()}", lambda: f"{r.randint(1, 12)}:{digits(2)}",
    )
    out = []
    for i in range(n):
        left = " ".join(word() for _ in range(r.randint(0, 4)))
        left += " " if left else ""
        if i % 2:
            kind = KINDS[(i // 2) % 4]
            value = makers[kind]()
            spans = [(len(left), len(left) + len(value), kind)]
        else:
            value, spans = r.choice(nothing)(), []
            spans = base_spans(value)
            spans = [(a + len(left), b + len(left), k) for a, b, k in spans]
        out.append((f"{left}{value}{r.choice((' ', ', ', '. '))}{word()} {word()}", spans))
    return out


def train(docs: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Weights from generated examples and at most `sample` documents of up to SAMPLE_BYTES with an anchor, the first by a
    hash of doc_id. Repeated rows count once."""
    rows = docs.where(F.col("text").rlike("[0-9@]") & F.col("doc_id").isNotNull() & (F.octet_length("text") <= SAMPLE_BYTES))
    rows = rows.select("doc_id", "text", F.xxhash64("text").alias(f"{OWN}hash"))
    chosen = rows.groupBy("doc_id", f"{OWN}hash").agg(F.lit(1)).select("doc_id", f"{OWN}hash").orderBy(F.xxhash64("doc_id"), "doc_id", f"{OWN}hash").limit(sample)
    texts = rows.join(F.broadcast(chosen), ["doc_id", f"{OWN}hash"], "left_semi").groupBy("doc_id", f"{OWN}hash").agg(F.min("text").alias("text"))
    return fit(generated() + [(r["text"], base_spans(r["text"])) for r in texts.orderBy("doc_id", f"{OWN}hash").collect()])


def added_spans(text: str, base: list[Span], weights: np.ndarray) -> list[Span]:
    """The spans of the field's best segmentation that are probable enough and meet no base span."""
    found: list[Span] = []
    ends = list(accumulate((s[1] for s in base), max))  # the largest end so far
    starts = [s[0] for s in base]
    for start, end in regions(text):
        near = base[bisect_right(ends, start) : bisect_left(starts, end)]
        region = Region(text, start, end, near)
        found += [(region.offsets[i], region.offsets[j], KINDS[k]) for i, j, k, sure in decode(region, weights) if sure >= ADD_FROM]
    return found


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


OUTPUTS = [*(f"n_{k}" for k in KINDS), "base_sha256", "spans"]


def find(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """docs with n_email, n_ip, n_card and n_phone (base spans), base_sha256 and spans (all of them).

    Columns of these names are replaced, all others pass through. A null text counts as empty and has no
    spans. Spans of one start are ordered by kind. Every row is by itself, so repeated rows get equal
    results; an empty table gives an empty result.
    """
    bound_batches(docs.sparkSession)
    docs = without(docs, OUTPUTS)

    @F.arrow_udf("struct<n_email: bigint, n_ip: bigint, n_card: bigint, n_phone: bigint, base_sha256: string, spans: string>")
    def spans(texts: pa.Array) -> pa.Array:
        columns: list[list] = [[] for _ in OUTPUTS]
        for t in texts:
            text = t.as_py()
            base = base_spans(text)
            every = sorted(base + added_spans(text, base, weights), key=_order)
            row = [*(sum(s[2] == k for s in base) for k in KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)]
            for column, value in zip(columns, row, strict=True):
                column.append(value)
        kinds = [pa.int64()] * 4 + [pa.string()] * 2
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], OUTPUTS)

    own = f"{OWN}spans"
    return docs.withColumn(own, spans(text_or_empty())).select([f"`{c}`" for c in docs.columns] + [f"{own}.*"])


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return find(docs, train(docs)).select("doc_id", *OUTPUTS)
