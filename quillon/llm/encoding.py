"""Text that was decoded with the wrong encoding: detection and repair by round trips.

A text is encoded again under each candidate wrong encoding and strictly decoded as the intended one; the cheapest
result is taken if a garbling cost drops, and the round repeats for nested layers. Where only a part was damaged,
the runs that are UTF-8 sequences under a wrong encoding are repaired in place. U+FFFD means that bytes were lost.

Defined results: null, empty and ASCII texts are clean; a damaged text whose bytes are lost has the empty string as
its original; long texts are taken whole; rows with a null id are left out; of repeated deliveries one row is kept.
"""

from __future__ import annotations

import functools
import math
import unicodedata
from operator import itemgetter

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The encodings text is wrongly read as when it was UTF-8, those of them whose sequences are no words,
# pairs (wrongly read as, really) of other origin, and the share in percent of the letters in Russian and Greek text.
WRONG_FOR_UTF8 = ("latin-1", "cp1252", "cp1250", "cp1251", "cp1253", "cp1254", "cp437", "cp850", "cp866", "mac_roman", "koi8-r", "iso8859-2", "iso8859-15")
LATIN_LEADS = ("latin-1", "cp1252", "mac_roman", "cp437", "cp850", "cp1251")
OTHER_PAIRS = tuple((w, i) for w in ("latin-1", "cp1252") for i in ("gb18030", "cp932", "euc_jp", "big5", "euc_kr", "cp1251", "koi8-r", "cp1253"))
CYRILLIC_PAIRS = (("cp1251", "koi8-r"), ("koi8-r", "cp1251"))
RUSSIAN_PERCENT = {
    "о": 10.97, "е": 8.45, "а": 8.01, "и": 7.35, "н": 6.70, "т": 6.26, "с": 5.47, "р": 4.73, "в": 4.54, "л": 4.40, "к": 3.49, "м": 3.21, "д": 2.98, "п": 2.81, "у": 2.62, "я": 2.01,
    "ы": 1.90, "ь": 1.74, "г": 1.70, "з": 1.65, "б": 1.59, "ч": 1.44, "й": 1.21, "х": 0.97, "ж": 0.94, "ш": 0.73, "ю": 0.64, "ц": 0.48, "щ": 0.36, "э": 0.32, "ф": 0.26, "ъ": 0.04, "ё": 0.5,
}
GREEK_PERCENT = {
    "α": 9.9, "ο": 8.5, "ι": 7.3, "ε": 7.2, "τ": 7.5, "σ": 4.9, "ν": 6.1, "η": 4.1, "υ": 3.5, "ρ": 4.3, "π": 4.1, "κ": 4.1, "μ": 3.4, "ς": 4.0, "λ": 3.2, "ω": 1.6, "γ": 1.9, "δ": 1.7,
    "θ": 1.3, "χ": 1.2, "φ": 0.8, "β": 0.7, "ξ": 0.4, "ζ": 0.4, "ψ": 0.2, "ά": 1.7, "έ": 1.9, "ή": 1.4, "ί": 2.6, "ό": 1.9, "ύ": 1.0, "ώ": 0.9, "ϊ": 0.1, "ϋ": 0.02, "ΐ": 0.02, "ΰ": 0.01,
}

MOST_LAYERS = 3
#: Longer texts are handled alike but not remembered, so that the caches stay small.
REMEMBERED_LENGTH = 1000
_C1_THROUGH = ("cp1252", "cp1250", "cp1251", "cp1253", "cp1254")
_LOST = "�"


def _char_of(wrong: str) -> dict[int, str]:
    """The character that each byte becomes; undefined bytes of the Windows code pages pass as C1 controls."""
    out = {}
    for b in range(128, 256):
        try:
            out[b] = bytes([b]).decode(wrong)
        except UnicodeDecodeError:
            if wrong in _C1_THROUGH and b < 0xA0:
                out[b] = chr(b)
    return out


@functools.cache
def _byte_of(wrong: str) -> dict[int, str]:
    """For str.translate: wrong character -> character of its byte value; all others map to themselves."""
    return {ord(c): chr(b) for b, c in _char_of(wrong).items()}


@functools.cache
def _outside(wrong: str) -> regex.Pattern:
    """Finds a character that the wrong encoding cannot have produced."""
    return regex.compile("[^\x00-\x7f" + regex.escape("".join(_char_of(wrong).values()), special_only=False) + "]")


@functools.cache
def _sequences(wrong: str) -> regex.Pattern:
    """UTF-8 multi-byte sequences as they look in the wrong encoding."""
    chars = _char_of(wrong)

    def some(lo: int, hi: int) -> str:
        return "[" + regex.escape("".join(chars[b] for b in range(lo, hi) if b in chars), special_only=False) + "]"

    tail = some(0x80, 0xC0)
    return regex.compile(f"(?:{some(0xC2, 0xE0)}{tail}|{some(0xE0, 0xF0)}{tail}{{2}}|{some(0xF0, 0xF5)}{tail}{{3}})+")


@functools.cache
def _signs(wrong: str) -> tuple[frozenset[str], frozenset[str]]:
    """Characters that begin and that continue a UTF-8 sequence as the wrong encoding shows it."""
    chars = _char_of(wrong)
    return frozenset(c for b, c in chars.items() if 0xC2 <= b < 0xF5), frozenset(c for b, c in chars.items() if b < 0xC0)


@functools.cache
def _any_sequence() -> regex.Pattern:
    """The beginning of a UTF-8 sequence under any of the wrong encodings."""
    lead, tail = (regex.escape("".join(sorted(set().union(*(_signs(w)[k] for w in WRONG_FOR_UTF8)))), special_only=False) for k in (0, 1))
    return regex.compile(f"[{lead}][{tail}]")


def _back(text: str, wrong: str, look: int) -> bytes | None:
    """The bytes that the wrong encoding was shown, None if it cannot have produced the text."""
    if look & _OUTSIDE[wrong]:
        return None
    return text.translate(_byte_of(wrong)).encode("latin-1")


_SUSPECT_SYMBOL = "¢£¤¥¦§¨©ª¬\xad®¯±²³´µ¶·¸¹º¼½¾×÷ƒˆ˜†‡•‰‹›€™√∫≈∆◊Ω∂∑∏∞≤≥≠⁄ﬁﬂ⌐⌠⌡∙ªΓΘΣΦ∩δε"
#: What garbling looks like, its weight, and a character without which it cannot occur.
_COSTS = tuple(
    (regex.compile(p), w, regex.compile(gate))
    for p, w, gate in (
        (r"[\x80-\x9f]", 2.0, r"[\x80-\x9f]"),
        (r"[-]|\p{Cn}", 3.0, r"\p{Co}|\p{Cn}"),
        (rf"(?<=[\p{{L}}\p{{S}}¡-¿])[{_SUSPECT_SYMBOL}]|[{_SUSPECT_SYMBOL}](?=\p{{L}})", 1.0, f"[{_SUSPECT_SYMBOL}]"),
        (r"[Â-ô][\x80-¿€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]", 1.5, r"[Â-ô]"),
        (r"(?<=\p{Latin})[\p{Cyrillic}\p{Greek}\p{Thai}\p{Arabic}\p{Hebrew}]|(?<=[\p{Cyrillic}\p{Greek}\p{Thai}\p{Arabic}\p{Hebrew}])\p{Latin}", 1.0, r"[\p{Cyrillic}\p{Greek}\p{Thai}\p{Arabic}\p{Hebrew}]"),
        (r"(?<=\p{Greek})[\p{Cyrillic}\p{Hebrew}\u0600-\u06ff]|(?<=\p{Cyrillic})[\p{Greek}\p{Hebrew}\u0600-\u06ff]|(?<=[\p{Hebrew}\u0600-\u06ff])[\p{Greek}\p{Cyrillic}]", 1.0, r"[\p{Cyrillic}\p{Hebrew}؀-ۿ]"),
        (r"[╨╤][^\s╨╤]|(?<=\p{L})[─-▟]|[─-▟](?=\p{L})|(?<=\p{L})[‚„]|[–—][^\s\p{L}\p{N}.,;:!?…–—\-]|‚[À-ÿ¢£]", 1.0, r"[─-▟‚„–—]"),
        (r"(?<!\p{Cyrillic})\p{Cyrillic}[°-¿]|(?<=[\p{Ll}\p{Lu}])[ↀ-⓿]|[ↀ-⓿](?=\p{L})", 1.0, r"[\p{Cyrillic}ↀ-⓿]"),
        (r"[\u0180-\u0217\u021c-\u024f]", 1.0, r"[ƀ-ȗȜ-ɏ]"),
        (r"[｡-ﾟ]|[ÃÂ][^\s\x00-\x7f]", 0.8, r"[｡-ﾟÃÂ]"),
        (r"(?<=\p{Latin})\p{Hangul}(?!\p{Hangul})|(?<![\p{Thai}\p{Devanagari}\p{Arabic}])[\u0300-\u036f]", 1.5, r"[\p{Hangul}̀-ͯ]"),
        (r"(?<=[a-z])\p{Han}{1,2}(?=[a-z])|(?<![^\s])\p{Han}(?=[a-z])", 3.0, r"\p{Han}"),
        (r"(?<=[\x21-\x7e])(?=[“„‚‘’”…–—])(?<![\s(\[A-Za-z0-9.,;:!?])|(?<=[‘’“”–—…‚„])[\p{L}--[A-Za-z]](?=[‘’“”–—…‚„])", 0.5, r"[“„‚‘’”…–—]"),
    )
)
#: Russian and Greek words and parts of them, which some code pages make UTF-8 sequences of ('её' in KOI8-R).
_MERE_WORD = regex.compile(r"(?=[\p{Cyrillic}\p{Greek}]+$)\p{Lu}?\p{Ll}+")
_CAPITAL_INSIDE = regex.compile(r"(?<=\p{Ll})\p{Lu}")
#: What the costs look at: characters beyond ASCII and two neighbours on either side.
_NEAR = regex.compile(r"[\x00-\x7f]{0,2}[^\x00-\x7f]+[\x00-\x7f]{0,2}")
_ACCENTED_WORD = regex.compile(r"(?<![\p{L}])[À-ÿŒœŠšŽžŸƒ]{2,}(?![\p{L}])|[À-ÿ]{3,}")
_ONE_ACCENTED = regex.compile(r"[À-ÿŒœŠšŽžŸƒ]")
_HAN = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]")
_CYR = regex.compile(r"[Ѐ-ӿ]")
_GREEK = regex.compile(r"[Ͱ-Ͽ]")
_GATES = (*(gate for _, _, gate in _COSTS), _ONE_ACCENTED, _HAN, _CYR, _GREEK)


@functools.lru_cache(maxsize=65_536)
def _opens(c: str) -> int:
    """The patterns that the character makes possible, as bits."""
    return sum(1 << k for k, gate in enumerate(_GATES) if gate.match(c))


#: Where none of these is, a text of other than Cyrillic letters was not read from a legacy encoding.
_SUSPECT = regex.compile(rf"[\x80-\x9f]|(?<=[\p{{L}}\p{{S}}¡-¿])[{_SUSPECT_SYMBOL}]|[{_SUSPECT_SYMBOL}](?=\p{{L}})|(?<!\p{{L}})[À-ÿŒœŠšŽžŸƒ]{{2,}}(?!\p{{L}})|[À-ÿ]{{3,}}|[‚ƒ„][^\s\w]|(?<=\p{{L}})[‚„ƒ]|‚[À-ÿ¢£]")
_SUSPECT_CHARS = frozenset({*map(chr, range(0x80, 0xA0)), *_SUSPECT_SYMBOL.replace("-", ""), *"‚ƒ„"})
_ACCENTED = regex.compile(r"[À-ÿŒœŠšŽžŸƒ]{2}")
#: Cyrillic whose letter case is exchanged, as KOI8-R and Windows-1251 show each other, has capitals in a row.
_INVERTED = regex.compile(r"[А-ЯЁЂ-Џ]{2}|[а-яёђ-џ][А-ЯЁ]")
_RUSSIAN = {k: min(0.6, 0.5 * (-math.log(v / 100) - 3.0)) for k, v in RUSSIAN_PERCENT.items()}
_GREEK_COST = {k: min(0.6, 0.5 * (-math.log(v / 100) - 3.0)) for k, v in GREEK_PERCENT.items()}


@functools.lru_cache(maxsize=32_768)
def _east_asian(c: str) -> tuple[float, float, float]:
    """Cost of one character in Chinese, Japanese and Korean text, by the level its national standard gives it."""

    def level(codec: str, lo: int, hi: int) -> float:
        try:
            b = c.encode(codec)
        except UnicodeEncodeError:
            return 1.5
        return 0.1 if len(b) == 2 and lo <= b[0] <= hi else 1.0

    name = unicodedata.name(c, "")
    if name.startswith(("HIRAGANA", "KATAKANA")):
        return 1.2, 0.1, 1.2
    if name.startswith("HANGUL"):
        return 1.2, 1.2, 0.1 if level("euc_kr", 0xB0, 0xC8) < 0.5 else 1.0
    return min(level("gb2312", 0xB0, 0xD7), level("big5", 0xA4, 0xC6) + 0.2), level("cp932", 0x88, 0x97), 1.0


def garbling(text: str) -> float:
    """How garbled a text looks; 0 for ordinary text."""
    near = "".join(_NEAR.findall(text))
    capitals = 0.8 * len(_CAPITAL_INSIDE.findall(text))
    return capitals + (_garbling(near) if len(near) <= REMEMBERED_LENGTH else _garbling.__wrapped__(near))


@functools.lru_cache(maxsize=16_384)
def _garbling(text: str) -> float:
    total = 0.05 * (len(text) - len(text.encode("ascii", "ignore")))
    opened = 0
    for c in set(text):
        if c > "\x7f":
            opened |= _opens(c)
    for k, (pattern, weight, _) in enumerate(_COSTS):
        if opened >> k & 1:
            total += weight * len(pattern.findall(text))
    accented, east, cyrillic, greek = (pattern.findall(text) if opened >> k & 1 else () for k, pattern in enumerate((_ACCENTED_WORD, _HAN, _CYR, _GREEK), len(_COSTS)))
    total += 0.7 * sum(map(len, accented))
    if east:
        costs = [_east_asian(c) for c in east]
        total += min(sum(x) for x in zip(*costs))
    if cyrillic:
        total += max(0.0, sum(_RUSSIAN.get(c.lower(), 1.5) for c in cyrillic))
    if greek:
        total += max(0.0, sum(_GREEK_COST.get(c.lower(), 1.5) for c in greek))
    return total


#: Bits of what a character can be: lead, tail or outsider under each wrong encoding, Cyrillic, suspect, accented.
_LEAD, _TAIL, _OUTSIDE = ({w: 1 << (3 * k + n) for k, w in enumerate(WRONG_FOR_UTF8)} for n in range(3))
_IS_CYRILLIC, _IS_SUSPECT, _IS_ACCENTED = (1 << (3 * len(WRONG_FOR_UTF8) + n) for n in range(3))


@functools.lru_cache(maxsize=65_536)
def _bits(c: str) -> int:
    out = (_IS_CYRILLIC if _CYR.match(c) else 0) | (_IS_SUSPECT if c in _SUSPECT_CHARS else 0) | (_IS_ACCENTED if _ONE_ACCENTED.match(c) else 0)
    for w in WRONG_FOR_UTF8:
        lead, tail = _signs(w)
        out |= (_LEAD[w] if c in lead else 0) | (_TAIL[w] if c in tail else 0) | (_OUTSIDE[w] if _outside(w).match(c) else 0)
    return out


def _look(text: str) -> int:
    """What the characters of the text can be, together."""
    out = 0
    for c in set(text):
        if c > "\x7f":
            out |= _bits(c)
    return out


def _explaining(text: str, look: int) -> list[str]:
    """The wrong encodings under which the text has UTF-8 sequences."""
    able = [w for w in WRONG_FOR_UTF8 if look & _LEAD[w] and look & _TAIL[w]]
    if not able or not _any_sequence().search(text):
        return []
    return [w for w in able if _sequences(w).search(text)]


def _pairs(text: str, look: int) -> tuple[tuple[str, str], ...]:
    """The pairs of other origin than UTF-8 that the looks of the text leave open."""
    if look & _IS_CYRILLIC:
        return CYRILLIC_PAIRS if _INVERTED.search(text) else ()
    return OTHER_PAIRS if (look & _IS_SUSPECT or (look & _IS_ACCENTED and _ACCENTED.search(text))) and _SUSPECT.search(text) else ()


def _whole(text: str, explaining: list[str], pairs: tuple[tuple[str, str], ...], look: int) -> tuple[list[str], list[str]]:
    """Strict round trips of the whole text under every encoding that explains it: as UTF-8, and as other encodings."""
    out: tuple[list[str], list[str]] = ([], [])
    raws: dict[str, bytes | None] = {}
    for wrong, right in (*((w, "utf-8") for w in explaining), *pairs):
        if wrong not in raws:
            raws[wrong] = _back(text, wrong, look)
        if raws[wrong] is not None:
            try:
                out[right != "utf-8"].append(raws[wrong].decode(right))
            except UnicodeDecodeError:
                pass
    return out


def _decoded(run: str, wrong: str) -> str:
    """A run of sequences as UTF-8, unchanged where it is none."""
    try:
        return run.translate(_byte_of(wrong)).encode("latin-1").decode("utf-8")
    except UnicodeDecodeError:
        return run


def _farthest(text: str, explaining: list[str]) -> list[str]:
    """The encodings but those whose sequences lie within another's that has more: one encoding damages a run."""
    if len(explaining) < 2:
        return explaining
    at = {w: {i for m in _sequences(w).finditer(text) for i in range(*m.span())} for w in explaining}
    return [w for w in explaining if not any(at[w] < other for other in at.values())]


def _parts(text: str, explaining: list[str], pairs: tuple[tuple[str, str], ...], look: int, partly: bool) -> list[str]:
    """The text with its damaged runs repaired, once for each wrong encoding that explains any; for pairs of other
    origin, with the stretches repaired that the wrong encoding can have produced. ``partly``: nothing explains the
    whole text, without which only the encodings of ``LATIN_LEADS`` count. The layers bring in further encodings."""
    if partly:
        used = _farthest(text, [w for w in explaining if w in LATIN_LEADS or not all(_MERE_WORD.fullmatch(m[0]) for m in _sequences(w).finditer(text))])
    else:
        used = [w for w in explaining if w in LATIN_LEADS]
    out = [_sequences(w).sub(lambda m, w=w: _decoded(m[0], w), text) for w in used]
    for wrong, right in pairs if partly else ():
        if look & _OUTSIDE[wrong]:
            out.append(_stretches(wrong).sub(lambda m, wrong=wrong, right=right: _read_as(m[0], wrong, right, used), text))
    return [new for new in out if new != text]


@functools.cache
def _stretches(wrong: str) -> regex.Pattern:
    """Stretches of characters that the wrong encoding can have produced, from the first beyond ASCII."""
    chars = regex.escape("".join(_char_of(wrong).values()), special_only=False)
    return regex.compile(f"[{chars}][\x00-\x7f{chars}]*")


def _read_as(stretch: str, wrong: str, right: str, used: list[str]) -> str:
    """The stretch as the pair has it; unchanged where it is none or UTF-8 sequences are all that is in it."""
    if any(_sequences(w).sub("", stretch).isascii() for w in used):
        return stretch
    try:
        return stretch.translate(_byte_of(wrong)).encode("latin-1").decode(right)
    except UnicodeDecodeError:
        return stretch


def repair(text: str | None) -> str | None:
    """The original of a damaged text, the empty string where bytes were lost, None for a clean text."""
    if not text or text.isascii():
        return None
    return _repair(text) if len(text) <= REMEMBERED_LENGTH else _repair.__wrapped__(text)


@functools.lru_cache(maxsize=65_536)
def _repair(text: str) -> str | None:
    if _LOST in text:
        return ""
    cost, best = _cheapest(text, MOST_LAYERS)
    if best is text or (cost >= 0 and cost >= garbling(text) - 0.3):
        return None
    return "" if _LOST in best else best


#: Of equally garbled results the first stays, so that the order of the encodings decides.
_cost = itemgetter(0)


def _cheapest(text: str, layers: int, partly: bool = False, own: float | None = None) -> tuple[float, str]:
    """The least garbled text that up to ``layers`` round trips lead to. A further layer is looked for in every
    result that is less garbled than the text it comes from, and in all strict round trips of the whole as UTF-8: a
    layer in between may look worse than the one above it."""
    candidates: dict[str, None] = {}
    as_utf8: list[str] = []
    if layers and not text.isascii():
        look = _look(text)
        explaining, pairs = _explaining(text, look), _pairs(text, look)
        if explaining or pairs:
            as_utf8, otherwise = _whole(text, explaining, pairs, look)
            if layers == MOST_LAYERS:
                partly = not (as_utf8 or otherwise)
            candidates = dict.fromkeys([*as_utf8, *otherwise, *_parts(text, explaining, pairs, look, partly)])
            candidates.pop(text, None)
    if not candidates:
        return own or 0.0, text
    own = garbling(text) if own is None else own
    best = (own, text)
    ahead = []
    for new in candidates:
        cost = garbling(new)
        best = min(best, (cost + 0.05, new), key=_cost)
        if cost > 0.25 and (cost < own or new in as_utf8):
            ahead.append((cost, new))
    for cost, new in ahead:
        deeper, end = _cheapest(new, layers - 1, partly, cost)
        best = min(best, (deeper + 0.05, end), key=_cost)
    return best


@F.arrow_udf(T.StringType())
def repaired(text: pa.Array) -> pa.Array:
    """The repaired text, empty where bytes were lost, null for a clean text."""
    seen: dict[str | None, str | None] = {}
    out = []
    for t in text.to_pylist():
        if t not in seen:
            seen[t] = repair(t)
        out.append(seen[t])
    return pa.array(out, pa.string())


def damaged_fields(items: DataFrame, fields: tuple[str, ...] = ("body", "sender"), id_col: str = "id") -> DataFrame:
    """(id, field, restored): one row per distinct id and damaged field. Only texts beyond ASCII reach Python, and
    only damaged rows are shuffled."""
    each = items.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields))).alias("x")
    )
    texts = each.select("id", "x.field", "x.text").where(F.col("text").rlike(r"[^\x00-\x7F]"))
    return texts.select("id", "field", repaired("text").alias("restored")).where("restored is not null").groupBy("id", "field").agg(F.min("restored").alias("restored"))


def found(items: DataFrame) -> DataFrame:
    made = damaged_fields(items)
    return made.select("id", "field", F.when(F.col("restored") == "", F.lit("")).otherwise(F.md5(F.col("restored").cast("binary"))).alias("restored_md5"))
