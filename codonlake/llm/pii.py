"""Personal data in whole texts, plain or disguised, with exact source offsets.

Plain identifiers come from four patterns. Then small transducers rewrite the
text - lookalike characters to ASCII, spelled digits to digits, "at" and "dot"
disguises to @ and . - while every output character remembers the source span
it came from. Identifiers found in the rewritten text that a rewrite touched,
and that are apart from or larger than the plain ones of their kind, are added
under source offsets; plain ones stay.

Cases: a null text is an empty one; offsets count code points; every pattern is
scanned in time linear in the text; repeated rows give repeated results; other
columns are ignored by ``find_spans`` and kept by ``redact``.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterable
from copy import copy
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
SPANS = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOTTED = re.compile(r"[0-9][0-9.]*")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def _emails(text: str):
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and _LOCAL.match(text, start - 1):
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            last = m.end()
        else:
            last = at + 1  # no local part crosses an @
        at = text.find("@", last)


def _ips(text: str):
    for run in _DOTTED.finditer(text):
        if run.group().count(".") < 3:
            continue
        for m in _IP.finditer(text, run.start(), run.end()):
            if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m.group().split(".")):
                yield m.span()


def _luhn(digits: str) -> bool:
    twice = [int(x) * 2 for x in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(x - 9 if x > 9 else x for x in twice)) % 10 == 0


def _cards(text: str):
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and _luhn(digits):
                yield m.span()


def _phones(text: str):
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(map(str.isdigit, m.group())) <= 15:
                yield m.span()


def plain_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index into KINDS, end), sorted."""
    return sorted((a, k, b) for k, find in enumerate((_emails, _ips, _cards, _phones)) for a, b in find(text))


# Lookalikes of Latin letters and of identifier punctuation (fixed values).
LOOKALIKES = dict(
    zip(
        "аеорсухіјѕһԁԛԝвкмнтАВЕКМНОРСТХУІЈЅαοινρτκχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ‐‑‒–—−․·",
        "aeopcyxijshdqwbkmhtABEKMHOPCTXYIJSaoivptkxABEZHIKMNOPTYX------..",
        strict=True,
    )
)
INVISIBLE = "­​‌‍‎‏⁠﻿"
_ODD = re.compile("[" + "".join(LOOKALIKES) + INVISIBLE + "！-～﹐-﹫٠-٩۰-۹०-९\U0001d400-\U0001d7ff]")
DIGIT_WORDS = {w: str(i) for i, w in enumerate("zero one two three four five six seven eight nine".split())}
_WORD = "|".join(DIGIT_WORDS)
_NUMBER = re.compile(rf"(?i)[0-9]+|(?<![^\W\d_])(?:plus|{_WORD})(?![^\W\d_])")
_NUMBER_HINTS = {*DIGIT_WORDS, "dot", "point", "plus"}
_LETTERS = re.compile("[a-z]+")
_SPELLED_DOT = re.compile(r"(?i)[ ]*(?:dot|point)[ ]*|\.")
_SPELLED_GAP = re.compile(r"[ ,()-]*")
LEAST_DIGITS = 4  # those of an ip
_BRACKETED = re.compile(r"(?i)(?<![ ])[ ]*[(\[{<][ ]*(at|dot)[ ]*[)\]}>][ ]*")
# Endings without which bare "at ... dot ..." is taken for ordinary prose: all country codes, and the older and common generic ones.
SUFFIXES = (
    "ac ad ae af ag ai al am ao aq ar as at au aw ax az ba bb bd be bf bg bh bi bj bm bn bo br bs bt bw by bz ca cc cd cf cg ch ci ck cl cm cn co cr cu cv cw cx cy cz "
    "de dj dk dm do dz ec ee eg er es et eu fi fj fk fm fo fr ga gd ge gf gg gh gi gl gm gn gp gq gr gs gt gu gw gy hk hm hn hr ht hu id ie il im in io iq ir is it "
    "je jm jo jp ke kg kh ki km kn kp kr kw ky kz la lb lc li lk lr ls lt lu lv ly ma mc md me mg mh mk ml mm mn mo mp mq mr ms mt mu mv mw mx my mz na nc ne nf ng ni nl no np nr nu nz "
    "om pa pe pf pg ph pk pl pm pn pr ps pt pw py qa re ro rs ru rw sa sb sc sd se sg sh si sk sl sm sn so sr ss st su sv sx sy sz tc td tf tg th tj tk tl tm tn to tr tt tv tw tz "
    "ua ug uk us uy uz va vc ve vg vi vn vu wf ws ye yt za zm zw "
    "com org net edu gov mil int arpa info biz name pro aero asia cat coop jobs mobi museum post tel travel "
    "academy agency app art bank berlin blog careers center chat city cloud club company consulting data dev digital email energy engineering events example expert finance fun fund global group health "
    "help host hosting house icu inc international invalid law legal life link live llc local london ltd mail market marketing media money network news ngo nyc one online page paris partners photo "
    "press school science services shop site social software solutions space store studio support systems tech technology test today tools top university ventures video vip website wiki work works world xyz zone"
)
_BRACKET_HINT = re.compile(r"[(\[{<][ ]*(?:at|dot)[ ]*[)\]}>]")
_AT_HINT = re.compile(r" at +[a-z0-9-]+\.[a-z0-9]")
_SUFFIXES = frozenset(SUFFIXES.split())
_JOINT = re.compile(r"(?i)(?<![ ])[ ]*(@)[ ]*|(?<![ ])[ ]+(at|dot)(?=[ ])")
_ATOM = re.compile(r"[ ]*([A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*)")


@cache
def _plain(char: str) -> str:
    if char in LOOKALIKES:
        return LOOKALIKES[char]
    if char in INVISIBLE:
        return ""
    if unicodedata.category(char) == "Nd":
        return str(unicodedata.decimal(char))
    like = unicodedata.normalize("NFKC", char)
    return like if len(like) == 1 and like.isascii() else char


#: Ways to read runs of numbers.
READINGS = ("apart", "close", "single")


class Rewritten:
    """A text under rewriting; character i came from source[starts[i]:ends[i]]."""

    def __init__(self, text: str):
        self.text, self.starts, self.ends = text, range(len(text)), range(1, len(text) + 1)

    def replace(self, parts: list[tuple[int, int, str]]) -> None:
        """Put each part's string in place of text[a:b]; parts are in order and apart."""
        if not parts:
            return
        out, starts, ends, at = [], [], [], 0
        for a, b, new in [*parts, (len(self.text), len(self.text), "")]:
            out += [self.text[at:a], new]
            starts += self.starts[at:a]
            ends += self.ends[at:a]
            if new:
                starts += [self.starts[a]] * len(new)
                ends += [self.ends[b - 1]] * len(new)
            at = b
        self.text, self.starts, self.ends = "".join(out), starts, ends

    def fold(self) -> None:
        self.replace([(m.start(), m.end(), new) for m in _ODD.finditer(self.text) if (new := _plain(m.group())) != m.group()])

    def said(self) -> None:
        """Signs for every at and dot that are bracketed, or join the parts of an address."""
        sign = {"at": "@", "dot": "."}
        if _BRACKET_HINT.search(self.text.lower()):
            self.replace([(m.start(), m.end(), sign[m[1].lower()]) for m in _BRACKETED.finditer(self.text)])
        low = self.text.lower()
        if not ("dot" in low or "@ " in low or " @" in low or _AT_HINT.search(low)):
            return  # no joint to rewrite
        text, last = self.text, 0
        joints = [(m.start(), m.end(), (m[1] or m[2]).lower()) for m in _JOINT.finditer(text)]
        parts = []
        for k, (at, after, word) in enumerate(joints):
            if word == "dot":
                continue
            first, i = at, k  # the local part, leftwards over dots
            before = []
            while True:
                stop = max(last, joints[i - 1][1] if i else 0)
                while first > stop and _LOCAL.match(text, first - 1):
                    first -= 1
                back = i and joints[i - 1][2] == "dot" and first < joints[i][0] and joints[i - 1][0] > last and not text[joints[i - 1][1] : first].strip(" ")
                if not (back and _LOCAL.match(text, joints[i - 1][0] - 1)):
                    break
                i -= 1
                before.append((joints[i][0], first, "."))
                first = joints[i][0]
            if first == at or not (m := _ATOM.match(text, after)):
                continue
            bare = word == "at" or after - at > 1
            head, ends, behind = m.start(1), [m.end()], []  # the domain, rightwards over dots
            inner = "." in m[1]
            known = [inner and m[1].rpartition(".")[2].lower() in _SUFFIXES]
            for start, end, kind in map(joints.__getitem__, range(k + 1, len(joints))):
                if kind != "dot" or start != ends[-1] or not (m := _ATOM.match(text, end)):
                    break
                behind.append((start, m.start(1), "."))
                ends.append(m.end())
                known.append(m[1].rpartition(".")[2].lower() in _SUFFIXES)
            disguised = any(self.ends[j] - self.starts[j] > 1 for j in range(first, ends[0]) if text[j] in "@.")
            if any(known):
                n = max(j for j, x in enumerate(known) if x)
            elif (disguised or not bare) and (inner or behind):
                n = 0 if inner else len(behind)
            else:
                continue
            parts += [*before[::-1], *([(at, head, "@")] if bare else []), *behind[:n]]
            last = ends[n]
        self.replace(parts)

    def spelled(self, reading: str) -> None:
        """Digits for every run of numbers in which some are words, or joined by spelled dots.

        A space stays between figures; if they are read ``apart``, between words
        and figures too; if ``single``, not between figures of one digit in a
        run with spelled dots.
        """
        if _NUMBER_HINTS.isdisjoint(_LETTERS.findall(self.text.lower())):
            return
        text, parts, run = self.text, [], []

        def close():
            if sum(len(w) if w.isdigit() else w.lower() in DIGIT_WORDS for w, *_ in run) < LEAST_DIGITS:
                return
            if all(w.isdigit() and (dot in (None, ".")) for w, _, _, dot in run):
                return
            dotted = reading == "single" and any(dot not in (None, ".") for *_, dot in run)
            for k, (w, a, b, dot) in enumerate(run):
                if k:
                    end, before = run[k - 1][2], run[k - 1][0]
                    figures = w.isdigit() + before.isdigit()
                    spaced = figures == 1 and reading == "apart" or figures == 2 and not (dotted and len(w) == len(before) == 1)
                    gap = "." if dot else " " if end < a and before.lower() != "plus" and spaced else ""
                    if text[end:a] != gap:
                        parts.append((end, a, gap))
                if not w.isdigit():
                    parts.append((a, b, "+" if w.lower() == "plus" else DIGIT_WORDS[w.lower()]))

        for m in _NUMBER.finditer(text):
            dot = None
            if run:
                gap = (run[-1][2], m.start())
                if run[-1][0].lower() != "plus" and _SPELLED_DOT.fullmatch(text, *gap):
                    dot = text[slice(*gap)].strip().lower()
                elif m[0].lower() == "plus" or not _SPELLED_GAP.fullmatch(text, *gap):
                    close()
                    run = []
            run.append((m[0], m.start(), m.end(), dot))
        if run:
            close()
        self.replace(parts)


class Taken:
    """Spans of each kind that do not overlap, in order; what overlaps a new one is found by bisection."""

    def __init__(self, spans: Iterable[tuple[int, int, int]] = ()):
        self.starts, self.ends = ([[] for _ in KINDS] for _ in "ab")
        for start, kind, end in sorted(spans):
            self.starts[kind].append(start)
            self.ends[kind].append(end)

    def over(self, start: int, kind: int, end: int) -> list[tuple[int, int]]:
        first, last = bisect_right(self.ends[kind], start), bisect_left(self.starts[kind], end)
        return list(zip(self.starts[kind][first:last], self.ends[kind][first:last]))

    def add(self, start: int, kind: int, end: int) -> None:
        k = bisect_left(self.starts[kind], start)
        self.starts[kind].insert(k, start)
        self.ends[kind].insert(k, end)


def added_spans(text: str, plain: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of disguised identifiers; each is apart from, or larger than, any plain one of its kind."""
    said = Rewritten(text)
    if not text.isascii():
        said.fold()
    said.said()
    found, known, read = [], Taken(plain), set()
    for reading in READINGS:
        new = copy(said)
        new.spelled(reading)
        if new.text == (text if reading == "apart" else said.text) or new.text in read:  # nothing new to read
            continue
        read.add(new.text)
        for a, kind, b in plain_spans(new.text):
            start, end = new.starts[a], new.ends[b - 1]
            if text[start:end] != new.text[a:b] and all(start <= s and e <= end and end - start > e - s for s, e in known.over(start, kind, end)):
                found.append((start, kind, end))
    out = Taken()  # of several readings the larger span
    for start, kind, end in sorted(set(found), key=lambda f: (f[0] - f[2], f)):
        if not out.over(start, kind, end):
            out.add(start, kind, end)
    return sorted((start, kind, end) for kind in range(len(KINDS)) for start, end in zip(out.starts[kind], out.ends[kind]))


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def _find(batches):
    for batch in batches:
        cols = [[] for _ in range(7)]
        for text in batch.column("text").to_pylist():
            plain = plain_spans(text)
            added = added_spans(text, plain)
            kinds = [k for _, k, _ in plain]
            for col, value in zip(cols, [*map(kinds.count, range(4)), hashlib.sha256(joined(plain).encode()).hexdigest(), joined(plain + added), len(added)]):
                col.append(value)
        types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, cols, types)], [x.split()[0] for x in SPANS.split(", ")])


def find_spans(docs: DataFrame) -> DataFrame:
    """Counts and digest of the plain spans, and all spans, of every document."""
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return texts.mapInArrow(_find, SPANS)


def redacted(text: str) -> str:
    """The text with every span, merged where they overlap, replaced by its kind."""
    plain = plain_spans(text)
    spans = sorted(plain + added_spans(text, plain))
    out, at, k = [], 0, 0
    while k < len(spans):
        start, kind, end = spans[k]
        while (k := k + 1) < len(spans) and spans[k][0] < end:
            end = max(end, spans[k][2])
        out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = end
    return "".join(out) + text[at:]


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced by [EMAIL], [IP], [CARD], [PHONE].

    A null text stays null; ``n_chars``, where there is one, follows the new text.
    """

    def over(batches):
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = [None if t is None else redacted(t) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    out = docs.mapInArrow(over, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
