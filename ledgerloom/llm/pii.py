"""Personal data: fixed patterns, and a semi-Markov conditional random field beside them.

The patterns (email, ip, card, phone) are what they are; their matches always stay.
The field adds spans that the patterns miss, such as addresses spelt out or numbers
written without a plus sign. It works on islands: runs of words that hold a digit,
an at sign or a spelling cue (also in brackets inside a word, as in john[at]site.com),
with a word on either side. Every segment of up to ``LONGEST`` words of an island, and
every whole address spelt in more words, is a candidate with features of the whole
span; a dynamic program over segments finds the best joint choice of boundaries and types.
Spans it adds carry the type with ``_like`` behind it, so counts of the four
pattern types mean the patterns.

The field's weights are learnt here, by gradient ascent on the likelihood of
islands made from written forms of each type and of plain numbers.

Defined results: a null text counts as empty and has no spans; rows with null or
repeated ids are rows like others; an empty table gives an empty result. Only the
id and text columns are read. Places are code points, ends exclusive.
"""

from __future__ import annotations

import functools
import hashlib
import math
import random
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.common import arrow_rows, send_code

KINDS = ("email", "ip", "card", "phone")
LIKE = tuple(k + "_like" for k in KINDS)
ORDER = {k: i for i, k in enumerate(KINDS + LIKE)}
LONGEST = 8  # words of a candidate segment; an address spelt in more is one as a whole

# ------------------------------------------------------------------ patterns
# Equal to the plain patterns, written so that no text takes more than linear time.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at) if start < at else None
        if match:
            done = match.end()
            out.append((start, done))
        at = text.find("@", match.end() if match else at + 1)
    return out


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Matches of the fixed patterns: (start, end, kind), by start and kind."""
    found = [(a, b, "email") for a, b in emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) < 256 for p in m.group().split(".")):
            found.append((m.start(), m.end(), "ip"))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                found.append((m.start(), m.end(), "phone"))
    return sorted(found, key=lambda s: (s[0], ORDER[s[2]]))


# ------------------------------------------------------------- the random field

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_CUE = re.compile(r"[0-9@]|^[\[({<]?(?:at|dot)[\])}>]?$|[\[({<](?:at|dot)[\])}>]", re.I)
_AT = re.compile(r"^[\[({<]?at[\])}>]?$", re.I)
_DOT = re.compile(r"^[\[({<]?dot[\])}>]?$", re.I)
_HIDDEN = re.compile(r"([\[({<](?:at|dot)[\])}>])", re.I)
_EDGES = "\"'.,;:!?<>[]{}|*&%$#"
# Shapes of spelt addresses; a chain of parts is met once, from its first part.
_SPELT = re.compile(r"[wn](?:\.[wn])*@[wn](?:\.[wn])*\.w")
_CHAIN = re.compile(r"(?<!\.)[wn](?:\.[wn])*+@[wn](?:\.[wn])*\.w")
_TO_SITE = re.compile(r"[wn](?:\.[wn])*@w")
_SITE = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
_NUMBER = re.compile(r"^[(+]?[0-9][0-9().+\-/]*$")
_HINTS = {"email": ("mail", "email", "e-mail", "contact"), "ip": ("ip", "host", "server", "address"),
          "card": ("card", "visa", "credit", "iban"), "phone": ("tel", "phone", "call", "fax", "mobile")}


def shape_of(word: str) -> str:
    """n for a number, w for any other word, @ and . for their spellings; a word with
    spellings in brackets inside has one letter for each of its parts."""
    parts = [p for p in _HIDDEN.split(word) if p] if _HIDDEN.search(word) else [word]
    return "".join("n" if _NUMBER.match(w.strip(_EDGES)) else "@" if _AT.match(w) else "." if _DOT.match(w)
                   else "w" for w in parts if len(parts) == 1 or w.strip(_EDGES + "()"))


def features(words: list[str], i: int, j: int, shapes: list[str]) -> tuple[str, ...]:
    """Names of the features of the segment of words i to j, as a whole."""
    span = words[i:j]
    text = " ".join(span).strip(_EDGES)
    digits = sum(c.isdigit() for c in text)
    found = [f"words{min(j - i, 4)}"]
    if span[0] != span[0].lstrip(_EDGES + "()") and not span[0].startswith("("):
        found.append("edge")
    shape = "".join(shapes[i:j])
    site = _TO_SITE.fullmatch(shape) and _HIDDEN.search(text) and _SITE.fullmatch(
        _HIDDEN.split(text)[-1].strip(" ()" + _EDGES))
    if (site or _SPELT.fullmatch(shape)) and text.isascii():
        found.append("spelt_email")
        if j - i == 1:
            found.append("glued_email")
    elif "@" in shape or "." in shape:
        found.append("cue_inside")
    if "w" in shape and "@" not in shape:
        found.append("plain_word")
    if set(shape) == {"n"}:
        found.append("numbers")
        if digits == 10 and not text.startswith("+"):
            found.append("ten_digits")
            if re.fullmatch(r"\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-][0-9]{4}", text):
                found.append("local_phone")
        if re.fullmatch(r"00[0-9]{1,3}[ .(-][0-9 .()-]{8,}", text) and 10 <= digits <= 17:
            found.append("zero_phone")
        if 13 <= digits <= 19 and re.fullmatch(r"[0-9]{4}[ .\-/][0-9]{4}[ .\-/][0-9]{4}[ .\-/][0-9]{1,7}", text):
            found.append("card_groups")
            if luhn("".join(c for c in text if c.isdigit())):
                found.append("card_luhn")
        if digits < 7:
            found.append("few_digits")
        if digits > 19:
            found.append("many_digits")
    if digits and re.fullmatch(r"[0-9]{1,3}(?:\s?(?:\[\.\]|\(\.\)|\[dot\]|\(dot\))\s?[0-9]{1,3}){3}", text, re.I):
        found.append("spelt_ip")
    if j < len(words) and shapes[j][:1] in ("@", "."):
        found.append("goes_on")
    if i and shapes[i - 1][-1:] in ("@", "."):
        found.append("began_before")
    before = words[i - 1].lower().strip(_EDGES + "()") if i else ""
    for kind, hints in _HINTS.items():
        if before in hints:
            found.append("hint_" + kind)
    return tuple(found)


def segments(words: list[str]):
    """(i, j, features) of every candidate; those of plain words alone are left out."""
    cued = [bool(_CUE.search(w)) for w in words]
    shapes = [shape_of(w) for w in words]
    for i in range(len(words)):
        for j in range(i + 1, min(len(words), i + LONGEST) + 1):
            if any(cued[i:j]):
                yield i, j, features(words, i, j, shapes)
    owner = [k for k, shape in enumerate(shapes) for _ in shape]
    for m in _CHAIN.finditer("".join(shapes)):
        i, j = owner[m.start()], owner[m.end() - 1] + 1
        if j - i > LONGEST:
            yield i, j, features(words, i, j, shapes)


def value(weights: dict, kind: str, names: tuple[str, ...]) -> float:
    return sum(weights.get((kind, n), 0.0) for n in names) + weights.get((kind, "bias"), 0.0)


def decode(words: list[str], weights: dict) -> list[tuple[int, int, str]]:
    """Best segmentation: words outside segments count nothing, typed segments their value."""
    ending: dict[int, list] = {}
    for i, j, names in segments(words):
        for kind in KINDS:
            v = value(weights, kind, names)
            if v > 0:
                ending.setdefault(j, []).append((v, i, kind))
    best, back = [0.0] * (len(words) + 1), [None] * (len(words) + 1)
    for j in range(1, len(words) + 1):
        best[j] = best[j - 1]
        for v, i, kind in ending.get(j, ()):
            if best[i] + v > best[j]:
                best[j], back[j] = best[i] + v, (i, kind)
    out, j = [], len(words)
    while j:
        if back[j]:
            out.append((back[j][0], j, back[j][1]))
            j = back[j][0]
        else:
            j -= 1
    return out[::-1]


def likelihood_step(words: list[str], gold: list[tuple[int, int, str]], weights: dict, step: dict) -> None:
    """Adds to ``step`` the gradient: features of the true segments less those expected."""
    listed = [(i, j, kind, names, value(weights, kind, names))
              for i, j, names in segments(words) for kind in KINDS]
    n = len(words)
    ahead, behind = [0.0] + [-math.inf] * n, [-math.inf] * n + [0.0]
    add = lambda a, b: b if a == -math.inf else max(a, b) + math.log1p(math.exp(-abs(a - b)))
    by_end, by_start = {}, {}
    for s in listed:
        by_end.setdefault(s[1], []).append(s)
        by_start.setdefault(s[0], []).append(s)
    for j in range(1, n + 1):
        ahead[j] = ahead[j - 1]
        for s in by_end.get(j, ()):
            ahead[j] = add(ahead[j], ahead[s[0]] + s[4])
    for i in range(n - 1, -1, -1):
        behind[i] = behind[i + 1]
        for s in by_start.get(i, ()):
            behind[i] = add(behind[i], behind[s[1]] + s[4])
    true = set(gold)
    for i, j, kind, names, v in listed:
        change = ((i, j, kind) in true) - math.exp(min(0.0, ahead[i] + v + behind[j] - ahead[n]))
        if abs(change) > 1e-6:
            for name in (*names, "bias"):
                step[kind, name] = step.get((kind, name), 0.0) + change


def made_islands(draw: random.Random, number: int):
    """Islands with known spans: written forms that the patterns miss, and other numbers."""
    word = lambda: "".join(draw.choice("abdeghilmnorst") for _ in range(draw.randint(2, 8)))
    digits = lambda n: "".join(draw.choice("0123456789") for _ in range(n))

    def card() -> str:
        while True:
            d = digits(16)
            if luhn(d):
                return draw.choice("/. ").join(d[k:k + 4] for k in range(0, 16, 4))

    forms = {
        "email": [lambda: f"{word()} at {word()} dot {word()}", lambda: f"{word()} at {word()} dot {word()} dot {word()}", lambda: f"{word()} [at] {word()} [dot] {word()}",
                  lambda: f"{word()}{digits(2)} (at) {word()} dot {word()} dot {word()}",
                  lambda: f"{word()}[at]{word()}.{word()}",
                  lambda: f"{word()}{opened}at{closed}{word()}{opened}dot{closed}{word()}",
                  lambda: f"{word()} {opened}at{closed} {word()}.{word()}",
                  lambda: f"{word()} dot {word()} at {word()} dot {word()}",
                  lambda: f"{word()} at {' dot '.join(word() for _ in range(draw.randint(4, 7)))}"],
        "phone": [lambda: f"({digits(3)}) {digits(3)}-{digits(4)}", lambda: f"{digits(3)}-{digits(3)}-{digits(4)}",
                  lambda: f"{digits(3)}.{digits(3)}.{digits(4)}", lambda: f"00{digits(2)} {digits(3)} {digits(3)} {digits(3)}"],
        "card": [card],
        "ip": [lambda: "[.]".join(str(draw.randint(0, 255)) for _ in range(4)),
               lambda: " (dot) ".join(str(draw.randint(0, 255)) for _ in range(4))],
        "": [lambda: digits(draw.randint(1, 9)), lambda: f"{digits(4)}-{digits(2)}-{digits(2)}",
             lambda: f"{digits(2)}.{digits(2)}", lambda: f"{digits(10)}", lambda: f"{digits(16)}",
             lambda: f"{digits(2)} {word()} {digits(3)}", lambda: f"{word()} at {word()}",
             lambda: f"dot {word()}", lambda: f"{word()}[at]{word()}", lambda: f"{word()} dot {word()}",
             lambda: f"{digits(8)}{word()}{digits(8)}", lambda: f"{digits(12)}",
             lambda: f"{digits(3)} {digits(3)} {digits(3)}", lambda: f"at {digits(2)} {word()}"],
    }
    for _ in range(number):
        kind = draw.choice(list(KINDS) + ["", "", ""])
        hint = [draw.choice(_HINTS[kind])] if kind and draw.random() < 0.3 else []
        opened, closed = draw.choice(("[]", "()", "{}"))
        head, body = [word() for _ in range(draw.randint(0, 2))] + hint, draw.choice(forms[kind])().split()
        tail = [word() for _ in range(draw.randint(0, 2))]
        if draw.random() < 0.3:
            body[-1] += draw.choice(".,;")
        yield head + body + tail, [(len(head), len(head) + len(body), kind)] if kind else []


@functools.lru_cache(maxsize=1)
def trained(seed: int = 7, number: int = 300, rounds: int = 40) -> dict:
    """Weights by adaptive gradient ascent, with a small ridge; the same on every run."""
    islands = list(made_islands(random.Random(seed), number))
    weights: dict = {}
    size: dict = {}
    for _ in range(rounds):
        step: dict = {}
        for words, gold in islands:
            likelihood_step(words, gold, weights, step)
        for k, g in step.items():
            g = g / number - 0.0005 * weights.get(k, 0.0)
            size[k] = size.get(k, 0.0) + g * g
            weights[k] = weights.get(k, 0.0) + 0.8 * g / (1e-8 + math.sqrt(size[k]))
    return weights


_ISLAND = re.compile(r"[0-9@]|(?<![^\s\[({<])(?:at|dot)(?![^\s\])}>])", re.I)


def added_spans(text: str, base: list[tuple[int, int, str]], weights: dict) -> list[tuple[int, int, str]]:
    """Spans of the field that touch no match of the patterns."""
    if not _ISLAND.search(text):
        return []
    places = [(m.start(), m.end()) for m in _WORD.finditer(text)]
    words = [text[a:b] for a, b in places]
    cued = [i for i, w in enumerate(words) if _CUE.search(w)]
    out, k = [], 0
    while k < len(cued):
        first = last = cued[k]
        while k + 1 < len(cued) and cued[k + 1] - last <= 2:
            k += 1
            last = cued[k]
        k += 1
        low, high = max(0, first - 2), min(len(words), last + 3)
        if last == first and len(words[first]) <= 4 and not _HIDDEN.search(words[first]):
            continue  # a lone short number or cue holds no candidate of any type
        island = words[low:high]
        for i, j, kind in decode(island, weights):
            a, b = places[low + i][0], places[low + j - 1][1]
            piece, edges = text[a:b], _EDGES + "()" if kind == "email" else _EDGES
            a += len(piece) - len(piece.lstrip(edges))
            b -= len(piece) - len(piece.rstrip(edges))
            if a < b and not any(s < b and a < e for s, e, _ in base):
                out.append((a, b, kind + "_like"))
    return out


def spans_of(text: str, weights: dict) -> tuple[list, list]:
    """The patterns' spans, and those with the field's spans among them."""
    base = base_spans(text)
    both = sorted(base + added_spans(text, base, weights), key=lambda s: (s[0], ORDER[s[2]]))
    return base, both


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``n_email``, ``n_ip``, ``n_card``, ``n_phone`` (the patterns' spans),
    ``base_sha256``, ``spans`` (all), ``n_added``."""
    weights = trained()
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    names = [id_col, *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]
    schema = T.StructType(
        [T.StructField(id_col, rows.schema["id"].dataType)] + [T.StructField(f"n_{k}", T.LongType()) for k in KINDS]
        + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()),
           T.StructField("n_added", T.LongType())])

    def run(batches):
        for batch in batches:
            counts, shas, spans, added = [[] for _ in KINDS], [], [], []
            for text in batch.column(1):
                base, both = spans_of(text.as_py() or "", weights)
                for k, out in zip(KINDS, counts):
                    out.append(sum(s[2] == k for s in base))
                shas.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(both))
                added.append(len(both) - len(base))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(shas, pa.string()),
                 pa.array(spans, pa.string()), pa.array(added, pa.int64())], names)

    return arrow_rows(rows, run, schema)


def masked(text: str, spans) -> str:
    """The text with every span replaced by its kind in angle brackets; overlapping
    spans become one, named by the first."""
    out, done = [], 0
    merged: list[list] = []
    for a, b, kind in spans:
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b, kind])
    for a, b, kind in merged:
        out += [text[done:a], f"<{kind.removesuffix('_like')}>"]
        done = b
    return "".join(out) + text[done:]


def mask_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the spans in its text masked; null texts stay null."""
    weights = trained()
    send_code(docs.sparkSession)

    @F.pandas_udf("string")
    def mask(texts):
        return texts.map(lambda t: None if t is None else masked(t, spans_of(t, weights)[1]))

    return docs.withColumn(text_col, mask(F.col(f"`{text_col}`")))
