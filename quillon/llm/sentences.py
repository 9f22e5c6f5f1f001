"""Sentence boundaries across languages and scripts.

A first pass over all documents counts, for every word, how often it stands before a full stop that surely ends a
sentence (the end of a line), before one at all, and without one. A word that is never last although often followed by a full stop is an abbreviation. In each document
the unambiguous occurrences in that document decide first; where it has none, the counts of the corpus do, then a
short list of titles. Scripts have their own terminators; Thai ends at a space after a polite particle.

Defined results: null, empty and blank texts have no sentences; texts are taken whole, whatever their length; a
null source is handled as a source whose line breaks end sentences.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.session import settle_table

# Abbreviations that stand before a name or a number, words before a German ordinal, words that may
# also end a sentence, names of days and months (they follow a time of day within a sentence), Thai particles that close a sentence, and the sources
# whose single line breaks are wrapping or whose lines begin with a speaker's label.
BEFORE_NAME = frozenset("Dr Mr Mrs Ms Prof St Sr Sra Dra M Mme Hr Fr vs cf e.g i.e approx z B d h z.B d.h ca EE UU Jan ул κ Δρ डॉ د".split())
BEFORE_NUMBER = frozenset("No Nr no nr N n Núm núm p pp S ca env approx Tel tel Art Fig Vol Kap стр № αρ".split())
ORDINAL_LEAD = frozenset("am der die das den dem des vom zum im ab bis seit ein eine einen".split())
MAY_END = frozenset("etc usw osv г др т.д пр p.m a.m U.S".split())
DAYS_AND_MONTHS = frozenset("Monday Tuesday Wednesday Thursday Friday Saturday Sunday January February March April May June July August September October November December".split())
THAI_PARTICLES = ("ครับ", "ค่ะ", "คะ", "จ้ะ", "จ๊ะ", "นะคะ", "นะครับ")
WRAPPED_SOURCES = ("letter",)
LABELLED_SOURCES = ("whatsapp", "sms", "imessage", "instagram")

#: Occurrences before the counts of a word are trusted; share of sure ends below which it is an abbreviation, and from which
#: a listed one is none; share of all full stops that a word of the table has which every worker gets: 50,000 words at most.
TRUSTED, END_SHARE, OFTEN_LAST_SHARE, LEAST_SHARE = 20, 0.03, 0.3, 0.00002

_LINE = regex.compile(r"[^\n\r\v\f\x1c-\x1e\x85  ]+")
_PARAGRAPH_END = regex.compile(r"(?:\r\n|[\n\r\x85 ])[^\S\n\r]*(?:\r\n|[\n\r\x85 ])\s*| \s*")
_CLOSERS = r"[\"”“’»«)\]}」』）】》〉〕］｝›]"
_EMOJI = r"(?:[\p{Extended_Pictographic}--[\d#*©®™]][︎️‍⃣\U0001F3FB-\U0001F3FF\U000E0020-\U000E007F]*|[\U0001F1E6-\U0001F1FF]{2})"
_END = regex.compile(rf"(?V1)(?:[.!?…]+|[。！？｡．።፧।॥؟۔։;;]+)(?:{_CLOSERS})*(?:\s*{_EMOJI})*")
_FULL = frozenset("。！？｡．።፧।॥؟۔")
_OPEN = {"“": "”", "„": "“”", "«": "»", "「": "」", "『": "』", "(": ")", "（": "）", "[": "]", "【": "】", "《": "》", "‹": "›"}
_MARK = regex.compile(r"[\"“”„«»「」『』()（）\[\]【】《》‹›]")
_WORD_BEFORE = regex.compile(r"(?r)[\p{L}\p{M}]+(?:[.\-][\p{L}\p{M}]+)*")
_NUMBER_BEFORE = regex.compile(r"(?r)(?<![\d:.,/])\d{1,3}")
_NEXT = regex.compile(r"\s*[\"“„«「『(（\[¿¡'’‘‹《【\-–—•*]*\s*(.)", regex.DOTALL)
_NEXT_WORD = regex.compile(r"\s*[\"“„«(¿¡]*([\p{L}\p{M}]+)")
#: A speaker's label may have initials and titles, but no sentence before its colon.
_LABEL = regex.compile(r"\s*(?:[^:\n\r.!?…。！？]|(?<=(?<!\p{L})\p{L}{1,4})\.)+?:(?=\s)")
_BULLET = regex.compile(r"\s*(?:[-•*‣◦–—·]\s+|\(?\d{1,3}[.)]\s+|\(?[A-Za-z][)]\s+)+")
_THAI = regex.compile("(?:" + "|".join(THAI_PARTICLES) + r")(?=[^\S\n\r]+\S)")
_GREEK_BEFORE = regex.compile(r"(?r)[\p{Greek}\p{M}]")
_TOKEN = r"[\p{L}\p{M}]++(?:[.\-][\p{L}\p{M}]++)*+"
_WORDS = regex.compile(_TOKEN)
#: A capital after a word in small letters, where no sentence begins. A title without its stop stands before a capital, a
#: name that needs none does not.
_NAME = regex.compile(r"[ \xa0](?=[\"“„«(]?\p{Lu})(?<=(?<![\p{L}\p{M}.\-])\p{Ll}[\p{Ll}\p{M}]*[ \xa0])[\"“„«(]?(\p{Lu}[\p{L}\p{M}]*+(?:[.\-][\p{L}\p{M}]++)*+)(?!\.|\s\p{Lu})")
#: A full stop that surely ends a sentence, or surely does not.
_SURE_STOP = regex.compile(r"\.(?=[\n\r]|\Z|\s\p{Ll})")


def _units(text: str, wrapped: bool) -> Iterator[tuple[int, int]]:
    """Stretches that no sentence leaves: lines, or paragraphs of wrapped text."""
    if not wrapped:
        for m in _LINE.finditer(text):
            yield m.span()
        return
    at = 0
    for m in _PARAGRAPH_END.finditer(text):
        yield at, m.start()
        at = m.end()
    yield at, len(text)


def _enclosed(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Outermost balanced quotations and brackets in the stretch, as sorted spans."""
    stack: list[tuple[str, int]] = []
    spans: list[tuple[int, int]] = []
    for m in _MARK.finditer(text, start, end):
        c, at = m[0], m.start()
        depth = next((k for k in range(len(stack) - 1, -1, -1) if c in stack[k][0]), None)
        if depth is not None:
            opened = stack[depth][1]
            del stack[depth:]
            while spans and spans[-1][0] > opened:
                spans.pop()
            spans.append((opened, at + 1))
        elif c == '"':
            stack.append(('"', at))
        elif c in _OPEN:
            stack.append((_OPEN[c], at))
    return spans


class Words:
    """What one document, the corpus and the lists say, in this order, about words before a full stop."""

    def __init__(self, never_last: frozenset[str], text: str, wrapped: bool, often_last: frozenset[str] = frozenset()) -> None:
        self.never_last, self.often_last, self.text, self.wrapped = never_last, often_last, text, wrapped
        self.last: Counter[str] | None = None
        self.names: frozenset[str] | None = None

    def _document(self) -> None:
        self.last, self.inside = Counter(), Counter()
        for m in _SURE_STOP.finditer(self.text):
            at = m.end()
            word = _WORD_BEFORE.match(self.text, pos=0, endpos=at - 1)
            if word is None:
                continue
            after = self.text[at : at + 2]
            if not after or (after[0] in "\n\r" and (not self.wrapped or not after.strip())):
                self.last[word[0]] += 1
            elif after[:1].isspace() and after[1:].islower():
                self.inside[word[0]] += 1

    def abbreviation(self, word: str, following: str = "") -> bool:
        """Whether a full stop after the word, before ``following`` with a capital, belongs to the word."""
        if self.last is None:
            self._document()
        inside, last = self.inside[word], self.last[word]
        if inside > 1 and not last and word not in MAY_END and not self.bare(word):
            return True
        # What is last in one place may be an initial or a title before a name of the document in another.
        if not inside and ((len(word) > 1 and self.name(word)) or (last and not self.name(following))):
            return False
        if word in self.never_last:
            return True
        if word in self.often_last:
            return False
        return word in BEFORE_NAME or word in BEFORE_NUMBER or (len(word) == 1 and word.isupper())

    def bare(self, word: str) -> bool:
        """Whether the document has the word without a full stop."""
        return regex.search(rf"(?<![\p{{L}}\p{{M}}.\-]){regex.escape(word)}(?![\p{{L}}\p{{M}}.])", self.text) is not None

    def name(self, word: str) -> bool:
        """Whether the document has the word as a proper name where no sentence begins."""
        if self.names is None:
            self.names = frozenset(_NAME.findall(self.text))
        return word in self.names


def _ends(text: str, m: regex.Match, start: int, end: int, words: Words) -> bool:
    """Whether this run of marks ends a sentence, given that it is not enclosed."""
    at, stop = m.start(), m.end()
    mark = text[at]
    if mark in ";;":
        if not _GREEK_BEFORE.match(text, pos=start, endpos=at):
            return False
    if stop >= end or not text[stop:end].strip():
        return True
    following = _NEXT.match(text, stop, end)
    first = following[1] if following else ""
    spaced = text[stop].isspace()
    if mark in _FULL:
        closed = text[stop - 1] in "”」』）】》〉»)\"" and not spaced
        return not (closed or first in "、，,；;：:")
    if not spaced:
        return False
    if first.islower() or first in ",;:)]}»”":
        return False
    dots = text[at:stop].rstrip("\"”“’»)]}")
    if dots != ".":
        return True
    if (number := _NUMBER_BEFORE.match(text, pos=start, endpos=at)) is not None:
        lead = _WORD_BEFORE.match(text, pos=start, endpos=max(start, number.start() - 1))
        return not (lead is not None and lead[0].lower() in ORDINAL_LEAD and first.isalpha())
    found = _WORD_BEFORE.match(text, pos=start, endpos=at)
    if found is None:
        return True
    word = found[0]
    nxt = _NEXT_WORD.match(text, stop, end)
    if first.isdigit():
        return not (word in BEFORE_NUMBER or word in BEFORE_NAME or words.abbreviation(word))
    if word in ("p.m", "a.m", "P.M", "A.M"):
        return not (nxt and nxt[1] in DAYS_AND_MONTHS)
    if word == "г":
        return text[max(start, found.start() - 2) : found.start()].strip()[-1:].isdigit()
    if word in ("No", "no"):
        return True
    return not words.abbreviation(word, nxt[1] if nxt else "")


def sentences(text: str | None, source: str | None = None, never_last: frozenset[str] = frozenset(), often_last: frozenset[str] = frozenset()) -> list[tuple[int, int]]:
    """Code point spans of the sentences of one text."""
    if not text or text.isspace():
        return []
    kind = (source or "").strip().lower()
    words = Words(never_last, text, kind in WRAPPED_SOURCES, often_last)
    thai_text = _THAI.search(text) is not None
    out: list[tuple[int, int]] = []
    for start, end in _units(text, kind in WRAPPED_SOURCES):
        if text[start:end].isspace() or start == end:
            continue
        body = start
        if kind in LABELLED_SOURCES and (m := _LABEL.match(text, start, end)):
            body = m.end()
        if m := _BULLET.match(text, body, end):
            body = m.end()
        cuts = []
        enclosed = _enclosed(text, body, end)
        opens = [a for a, _ in enclosed]
        for m in _END.finditer(text, body, end):
            k = bisect_right(opens, m.start()) - 1
            if k >= 0 and m.start() < enclosed[k][1] and enclosed[k][1] > m.end():
                continue
            if k >= 0 and m.start() < enclosed[k][1] and not text[m.end() : end].strip():
                continue
            if _ends(text, m, start, end, words):
                cuts.append(m.end())
        if thai_text and (thai := [m.end() for m in _THAI.finditer(text, body, end)]):
            emoji = regex.compile(rf"(?V1)(?:\s*{_EMOJI})*")
            cuts = sorted({*cuts, *(emoji.match(text, c, end).end() for c in thai)})
        at = start
        for cut in [*cuts, end]:
            a, b = at, cut
            while a < b and text[a].isspace():
                a += 1
            while b > a and text[b - 1].isspace():
                b -= 1
            if a < b:
                out.append((a, b))
            at = max(at, cut)
    return out


def word_evidence(documents: DataFrame) -> DataFrame:
    """(word, stops, sure_ends, bare) over all documents: with a full stop, with one at the end of its line or
    paragraph, and without one."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, stops, ends = Counter(), Counter(), Counter()

        def flush() -> pa.RecordBatch:
            counts = ([stops[w] for w in words], [ends[w] for w in words], [n - stops[w] for w, n in words.items()])
            columns = [pa.array(list(words), pa.string()), *(pa.array(c, pa.int64()) for c in counts)]
            return pa.record_batch(columns, names=["word", "stops", "sure_ends", "bare"])

        for batch in batches:
            for text, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not text:
                    continue
                words.update(_WORDS.findall(text))
                wrapped = (source or "").strip().lower() in WRAPPED_SOURCES
                if "." in text:
                    for start, end in _units(text, wrapped):
                        at = text.find(".", start, end)
                        while at >= 0:
                            if (at + 1 >= end or not text[at + 1].isalnum()) and (m := _WORD_BEFORE.match(text, pos=start, endpos=at)):
                                stops[m[0]] += 1
                                if not text[at + 1 : end].strip(" \t\xa0\"”»)"):
                                    ends[m[0]] += 1
                            at = text.find(".", at + 1, end)
            if len(words) > 200_000:
                yield flush()
                words, stops, ends = Counter(), Counter(), Counter()
        yield flush()

    counted = documents.select("text", "source").mapInArrow(count, "word string, stops long, sure_ends long, bare long")
    return counted.groupBy("word").agg(*(F.sum(c).alias(c) for c in ("stops", "sure_ends", "bare")))


def corpus_words(documents: DataFrame) -> tuple[frozenset[str], frozenset[str]]:
    """Words that a full stop often follows and that the corpus never shows last; and the listed words that it mostly
    shows without one and otherwise often last. Each has at least ``LEAST_SHARE`` of all full stops."""
    evidence = settle_table(word_evidence(documents).where(F.col("stops") > 0), "words")
    every = evidence.agg(F.sum("stops")).first()[0] or 0
    trusted = evidence.where(F.col("stops") >= max(TRUSTED, LEAST_SHARE * every))
    never = (F.col("sure_ends") < END_SHARE * F.col("stops")) & (F.col("bare") * 2 < F.col("stops"))
    often = F.col("word").isin(*BEFORE_NAME) & (F.col("sure_ends") >= OFTEN_LAST_SHARE * F.col("stops")) & (F.col("bare") > F.col("stops"))
    rows = trusted.select("word", never.alias("never"), often.alias("often")).where("never or often").collect()
    return frozenset(r.word for r in rows if r.never), frozenset(r.word for r in rows if r.often)


def abbreviations(documents: DataFrame) -> frozenset[str]:
    """Words that a full stop often follows and that the corpus never shows last."""
    return corpus_words(documents)[0]


def split(documents: DataFrame) -> DataFrame:
    """(doc_id, sent_start, sent_end): one row per sentence of every document."""
    never_last, often_last = corpus_words(documents)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, starts, ends = [], [], []
            for doc, text, source in zip(*(c.to_pylist() for c in batch.columns)):
                spans = sentences(text, source, never_last, often_last)
                ids += [doc] * len(spans)
                starts += [a for a, _ in spans]
                ends += [b for _, b in spans]
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], names=["doc_id", "sent_start", "sent_end"])

    return documents.select(F.col("doc_id").cast("long"), "text", "source").mapInArrow(cut, "doc_id long, sent_start long, sent_end long")
