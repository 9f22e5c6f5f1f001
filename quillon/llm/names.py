"""Variant spellings of one person or organisation.

Every spelling is read as one or more forms: p a full name (given name with its short forms resolved, and surname), r the
same in the other order where neither word is known as a given name,
i an initial with a surname, q a short form that several given names have, o an organisation (business words and
root), u a name written in one word, h, k and v the words of a name written together, x an exact label (a handle with
digits, a face). Equal forms meet at once. Full names and organisations whose words differ by one edit, in the given
name, the surname or both, are found by a pigeonhole segment join: a word is cut into k + 1 segments, the segments
are indexed with their length, position-shifted substrings looked up, and hits verified with a banded edit distance;
a segment that very many forms share is cut further. Entity rows that hang together are one person or firm;
spellings with an initial, or with a short form of several names, only join if one such name fits. Beside its forms
every spelling has its sorted words, the same for an entity and a sender, which meet in a second round.

Short forms come from a general list and from the corpus: two given names, or two words of a firm, that stand for
each other in spellings of several entity rows. Business words and given names are words of a share of all names.

Defined results: null and blank spellings, phone numbers, role and kinship words have no form; rows with a null id
are left out; places are no entities here; a spelling repeated in many rows is handled once.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.encoding import repair
from quillon.operators.graph import components
from quillon.session import settle_table

# Common short forms of given names in several languages, to which the corpus adds its own; titles; legal
# forms and articles; words that name a role, a relation or a device and nobody in particular; additions of address
# books and of handles.
SHORT_FORMS = {
    "abigail": "abby gail", "adelaide": "addie", "agnieszka": "aga", "albert": "bert al", "alejandro": "ale jandro", "aleksandra": "ola", "alexander": "alex sasha xander sandy lex", "alexandra": "alex sasha sandra lexi",
    "alexei": "alyosha lyosha", "alfred": "fred alf", "amanda": "mandy", "anastasia": "nastya stacy ana", "andreas": "andi", "andrew": "andy drew", "anthony": "tony ant", "antonio": "toni tonio", "arthur": "art", "barbara": "barb babs",
    "bartholomew": "bart", "beatrice": "bea trixie", "beatriz": "bia bea", "benedikt": "bene", "benjamin": "ben benny benji", "bernard": "bernie", "bradley": "brad", "caroline": "carrie caro", "catherine": "cathy kate kitty", "charles": "charlie chuck chas",
    "charlotte": "lottie charlie", "christina": "tina chrissy", "christopher": "chris kit topher", "clifford": "cliff", "concepcion": "concha", "cynthia": "cindy", "daniel": "dan danny", "david": "dave davy", "deborah": "deb debbie", "dmitri": "dima mitya",
    "dolores": "lola", "donald": "don donny", "dorothy": "dot dottie dolly", "edward": "ned eddie ed", "ekaterina": "katya", "eleanor": "nell ellie nora", "elizabeth": "beth liz betty lizzie eliza", "emanuel": "manny", "enrique": "quique", "eugene": "gene",
    "evgeny": "zhenya", "florence": "flo", "frances": "fran fanny", "francesco": "checco", "francisco": "paco fran pancho", "franklin": "frank", "frederick": "fred freddie", "friedrich": "fritz fred", "gabriela": "gabi gaby", "geoffrey": "geoff",
    "gerald": "gerry jerry", "giovanni": "gianni vanni", "giuseppe": "beppe peppe", "gregory": "greg", "guadalupe": "lupe lupita", "harold": "harry hal", "heinrich": "heinz heiner", "helena": "lena", "henrietta": "etta hattie hetty", "henry": "harry hank",
    "ignacio": "nacho", "isabella": "isa bella izzy", "ivan": "vanya", "jacob": "jake", "jacqueline": "jackie", "james": "jim jimmy jamie", "jeffrey": "jeff", "jennifer": "jen jenny", "jessica": "jess jessie", "joachim": "jochen achim",
    "johannes": "hans johan", "john": "jack johnny", "jonathan": "jon jonny", "jose": "pepe", "josef": "sepp", "joseph": "joe joey", "joshua": "josh", "judith": "judy", "katherine": "katie kathy kat kate kathie", "kenneth": "ken kenny",
    "konstantin": "kostya", "lawrence": "larry laurie", "leonard": "leo len lenny", "leonardo": "leo", "ludwig": "lutz", "luigi": "gigi", "magdalena": "magda lena", "manuel": "manolo", "margaret": "peggy maggie meg", "maria": "masha", "martha": "marty",
    "matthew": "matt matty", "maximilian": "max", "mercedes": "merche", "michael": "mike mick mikey", "mikhail": "misha", "montserrat": "montse", "natalia": "natasha", "nathaniel": "nate nat", "nicholas": "nick nicky", "nikolai": "kolya", "olga": "olya",
    "olivia": "liv livvy", "pamela": "pam", "patricia": "pat trish patty", "patrick": "pat paddy", "pavel": "pasha", "penelope": "penny", "peter": "pete", "philip": "phil pip", "raymond": "ray", "rebecca": "becky becca", "reginald": "reg",
    "richard": "rick dick rich", "robert": "rob bob bobby", "ronald": "ron ronnie", "rosario": "charo", "samantha": "sam", "samuel": "sam sammy", "sarah": "sally sadie", "sebastian": "seb basti", "sergei": "seryozha", "sofia": "sonya", "stanley": "stan",
    "stephanie": "steph", "stephen": "steve stevie", "susan": "sue susie", "susanne": "susi", "svetlana": "sveta", "tatiana": "tanya", "teresa": "terry tess", "theodore": "ted teddy theo", "thomas": "tom tommy", "timothy": "tim timmy", "tobias": "tobi",
    "ursula": "uschi", "victor": "vic", "victoria": "tori vicky", "vincent": "vince vinnie", "virginia": "ginny", "vladimir": "vova", "walter": "walt", "wilhelmina": "mina", "william": "bill will billy", "wolfgang": "wolf", "yevgenia": "zhenya", "yuri": "yura", "zachary": "zach zac",
}
TITLES = frozenset("dr prof professor mr mrs ms miss sir sr sra dra srta herr frau mme mlle".split())
LEGAL = frozenset("ltd limited llc inc gmbh ag sl sa plc co corp company kg bv the and".split())
NOBODY = frozenset(
    "me you mum mom mother dad father papa mama grandma grandpa granny nan uncle aunt auntie sister brother son daughter wife husband partner boss office work home mobile phone team lead neighbour neighbor "
    "landlord landlady plumber doctor dentist teacher babysitter manager unknown unbekannt family group admin support info bakery colleague friend school".split()
)
ADDITIONS = frozenset("mobile work home cell private new old office phone".split())

#: Edits in a word. A word is cut into EDITS + 1 segments, with one character between them that is in neither, since a
#: swap of neighbours damages two characters.
EDITS = 1
#: Forms under one segment from which the segment is cut further, and how often.
HOT_FORMS, HOT_CUTS = 1000, 4
#: A word is a business word or a given name from this many names on, and from a share of all words of such names that
#: bounds the tables which every worker gets: 1,000 business words and 10,000 given names.
LEARNED_FROM, BUSINESS_SHARE, GIVEN_SHARE = 4, 0.001, 0.0001
#: A business word has at least this share of the most frequent one's names: a root that variants of one firm share has less.
OF_MOST = 0.05
#: Names in which two words must stand for each other, and their share of all such words: 10,000 pairs at most.
STAND_FROM, STAND_SHARE = 2, 0.0001
#: Two words one edit apart are two names, not a slip, where both stand in this many different names and neither in
#: ``SLIP_TIMES`` as many as the other.
NAME_FROM, SLIP_TIMES = 3, 10
#: A word that no more firms than this have is looked up alone, as is a firm's rarest, any other with a word beside it.
RARE_FIRMS = 100
#: Letters of an abbreviation by which it is looked up.
BRIEF = 4
#: One edit makes another name of a single word shorter than this, and of words written together shorter than that.
WORD_EDIT_FROM, JOINED_EDIT_FROM = 4, 8

_FOLDS = str.maketrans({"ł": "l", "ø": "o", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe", "ı": "i", "ð": "d", "þ": "th", "ħ": "h"})
_DECOR = regex.compile(r"\([^)]*\)|[\p{So}\p{Sk}\p{Cf}\p{Co}️‍]|\s\d{1,2}$")
_LABEL = regex.compile(r"^(?:face:.+|[\p{L}\p{M}]+[._\-]?\d+)$")
_HANDLE_TAIL = regex.compile(r"(?:[._\-](?:x|photo|photos|official|real|hd))?[._\-]*$")
_SPLIT = regex.compile(r"[\s._\-,]+")


def fold(text: str) -> str:
    """Lower case without marks."""
    flat = unicodedata.normalize("NFKD", text.casefold().translate(_FOLDS))
    return "".join(c for c in flat if not unicodedata.combining(c)).translate(_FOLDS)


def within_one(a: str, b: str) -> bool:
    """Whether one insertion, deletion, substitution or swap of neighbours at most turns ``a`` into ``b``: the band
    of the edit matrix shrinks to the common prefix and suffix."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    ra, rb = a[i:], b[i:]
    if len(ra) == len(rb):
        return ra[1:] == rb[1:] or (len(ra) > 1 and ra[0] == rb[1] and ra[1] == rb[0] and ra[2:] == rb[2:])
    return ra[1:] == rb if len(ra) > len(rb) else ra == rb[1:]


def shortens(short: str, word: str) -> bool:
    """Whether ``short`` abbreviates ``word``: its beginning, or its first letter and consonants in their order."""
    if not 2 <= len(short) < len(word) or short[0] != word[0]:
        return False
    letters = iter(word)
    return word.startswith(short) or (not set(short[1:]) & set("aeiou") and all(c in letters for c in short))


class Reader:
    """Reads spellings as forms (kind, given, surname). ``stand_for``: (word, fuller word) pairs of the corpus."""

    def __init__(self, givens: list[str], business: list[str], stand_for: list[tuple[str, str]] = (), short_forms: dict[str, str] = SHORT_FORMS) -> None:
        self.business = frozenset(business)
        self.formal: dict[str, tuple[str, ...]] = {}
        for name, shorts in short_forms.items():
            self.formal.setdefault(name, ())
            for s in shorts.split():
                self.formal[s] = (*self.formal.get(s, ()), name)
        self.formal = {k: v or (k,) for k, v in self.formal.items()}
        full_word: dict[str, set[str]] = {}
        for short, name in stand_for:
            if short in self.business or name in self.business:
                brief, full = (short, name) if name in self.business else (name, short)
                full_word.setdefault(brief, set()).add(full)
                continue
            fuller = self.formal.get(name, (name,))
            if not set(fuller) & set(self.formal.get(short, ())):
                self.formal[short] = tuple(dict.fromkeys((*self.formal.get(short, ()), *fuller)))
                self.formal.setdefault(name, fuller)
        self.full_word = {brief: min(full) for brief, full in full_word.items() if len(full) == 1}
        for g in givens:
            self.formal.setdefault(g, (g,))
        self.shorts: dict[str, list[str]] = {}
        for token, names in self.formal.items():
            if len(names) == 1:
                self.shorts.setdefault(names[0], []).append(token)
        self.ambiguous: dict[str, list[str]] = {}
        for token, names in self.formal.items():
            if len(names) > 1:
                for n in names:
                    self.ambiguous.setdefault(n, []).append(token)
        self.by_letter: dict[str, list[str]] = {}
        for w in self.business:
            self.by_letter.setdefault(w[:1], []).append(w)
        self.words: dict[str, str | None] = {}

    def word(self, token: str) -> str | None:
        """The business word that a token is, its shortened forms and typos included."""
        if token not in self.words:
            if len(self.words) > 100_000:
                self.words.clear()
            self.words[token] = self._word(token)
        return self.words[token]

    def _word(self, token: str) -> str | None:
        token = self.full_word.get(token, token)
        if token in self.business:
            return token
        for same in (str.startswith, lambda w, t: shortens(t, w)):
            longer = [w for w in self.by_letter.get(token[:1], ()) if same(w, token)] if len(token) >= 3 else []
            if longer:
                return longer[0] if len(longer) == 1 else None
        close = [w for w in self.business if abs(len(w) - len(token)) <= 1 and within_one(token, w)] if len(token) >= 6 else []
        return close[0] if len(close) == 1 else None

    def organisation(self, tokens: list[str], sure: bool = True) -> tuple[str, str, str] | None:
        """The form of a name of business words and at least one word beside them; where it is not ``sure`` that this
        is a firm, a given name is no business word cut short."""
        kept = [t for t in tokens if t not in LEGAL and t != "s" and t != "l"]
        words = [(t, self.word(t) if sure or t not in self.formal else None) for t in kept]
        roots = sorted(t for t, w in words if w is None)
        kinds = sorted({w for _, w in words if w})
        return ("o", " ".join(kinds), " ".join(roots)) if kinds and roots and max(map(len, roots)) > 1 else None

    def together(self, a: str, b: str) -> list[tuple[str, str, str]]:
        """The words of a full name written in one, h as they are, k under every other short form, v under short forms
        that several names have."""
        names = self.formal.get(a, (a,))
        sole = dict.fromkeys((*names, *self.shorts.get(names[0], ()))) if len(names) == 1 else {}
        shared = self.ambiguous.get(names[0], ()) if len(names) == 1 else ()
        return [(t, "", x) for t, tokens in (("h", (a,)), ("k", [s for s in sole if s != a]), ("v", [s for s in shared if s != a])) for g in tokens for x in (g + b, b + g)]

    def cleaned(self, spelling: str | None) -> tuple[str, list[str]]:
        """A spelling without additions, and its folded words; a label is folded and, like what names nobody, has none."""
        if not spelling:
            return "", []
        text = unicodedata.normalize("NFKC", repair(spelling) or spelling).strip()
        if _LABEL.match(fold(text)):
            return fold(text), []
        text = _DECOR.sub(" ", text).strip(" .,;:_-")
        words = text.split()
        while len(words) > 1 and fold(words[-1]) in ADDITIONS:
            words.pop()
        text = " ".join(words)
        if not text or text[0] == "+" or regex.fullmatch(r"[\d\s()+\-./]*", text) or _LABEL.match(fold(text)):
            return "", []
        if " " not in text:
            text = _HANDLE_TAIL.sub("", text)
        tokens = [t for t in _SPLIT.split(fold(text).replace("&", " ")) if t]
        return text, [] if all(t in NOBODY for t in tokens) else tokens

    def fallback(self, spelling: str | None) -> tuple[str, str, str] | None:
        """The form that a spelling has whatever its kind: w its sorted words, grouped by the first letter where it
        is one word; n the same where many may bear it, a given name alone or a surname with initials."""
        text, tokens = self.cleaned(spelling)
        kept = sorted(t for t in tokens if t not in LEGAL and t not in TITLES) or sorted(tokens)
        if not kept or _LABEL.match(text):
            return None
        many = kept[0] in self.formal if len(kept) == 1 else sum(len(t) > 1 for t in kept) < 2
        return ("n" if many else "w", kept[0][0] if len(kept) == 1 else "", " ".join(kept))

    def forms(self, spelling: str | None, kind: str | None) -> list[tuple[str, str, str]]:
        text, tokens = self.cleaned(spelling)
        if _LABEL.match(text):
            return [("x", "", text)]
        if not tokens:
            return []
        if len(tokens) == 1:
            one = tokens[0]
            return [("u", "", one), *([("i", one[0], one[1:])] if len(one) > 3 and kind != "org" else [])] if len(one) > 1 and one not in self.formal else []
        plain = [t for t in tokens if t not in LEGAL]
        firm = self.organisation(tokens, kind == "org") if kind != "person" else None
        if firm is None and kind == "org":
            firm = ("o", "", " ".join(sorted(plain)))
        if firm:
            return [firm, ("h", "", "".join(plain))]
        people = [t for t in tokens if t not in TITLES] or tokens
        long = [t for t in people if len(t) > 1]
        if len(long) == 1 and len(people) > 1:
            initials = [t for t in people if len(t) == 1]
            return [("i", initials[0], long[0])]
        if len(long) < 2:
            return []
        if "," in text:
            before = {t for t in _SPLIT.split(fold(text.split(",", 1)[0])) if t}
            back, front = [t for t in long if t in before], [t for t in long if t not in before]
            orders = [(front, back)] if front and back else [(long[:1], long[1:])]
        else:
            capitals = {fold(t) for t in _SPLIT.split(text) if len(t) > 1 and t.isupper()}
            first, last = long[0] in self.formal, long[-1] in self.formal
            straight, turned = (long[:1], long[1:]), (long[-1:], long[:-1])
            if first or (len(long) > 2 and not last):
                orders = [straight]
            elif last or (long[0] in capitals and len(capitals) == 1):
                orders = [turned]
            else:
                orders = [straight, turned]
        out = []
        for k, (front, back) in enumerate(orders):
            given, rest = " ".join(front), " ".join(back)
            names = self.formal.get(given, (given,))
            if len(names) == 1:
                out.append(("r" if k else "p", names[0], rest))
            else:
                out += [("r" if k else "p", given, rest), *(("q", f"{given}\t{n}", rest) for n in names)]
            out += self.together(given.replace(" ", ""), rest.replace(" ", ""))
        return list(dict.fromkeys(out))


def _key(group: Column, length: Column, no: int, text: Column) -> Column:
    return F.concat_ws("\x1f", group, length.cast("string"), F.lit(str(no)), text)


def _head(n: Column) -> Column:
    """The length of the first of two segments of a word of ``n`` letters; the second follows after one letter."""
    return ((n - 1) / 2).cast("int")


def segments(group: Column, s: Column) -> Column:
    """The two segments of an indexed word, as (key, the rest of the word)."""
    n = F.length(s)
    a = _head(n)
    first = F.struct(_key(group, n, 0, F.substr(s, F.lit(1), a)).alias("k"), F.substr(s, a + 1).alias("rest"))
    last = F.struct(_key(group, n, 1, F.substr(s, a + 2)).alias("k"), F.substr(s, F.lit(1), a + 1).alias("rest"))
    return F.array(first, last)


def lookups(group: Column, s: Column, lengths: Column) -> Column:
    """The substrings that a word looks up, as (key, the rest): for each length of an indexed word, the first
    segment at its place and the last at its place from the end. Bits of ``lengths``: shorter, equal, longer."""
    n = F.length(s)
    out = []
    for k, more in enumerate(range(-EDITS, EDITS + 1)):
        m = n + more
        a = _head(m)
        tail = m - a - 1
        able = (m > 0) & (lengths.bitwiseAND(1 << k) > 0)
        out.append(F.when(able, F.struct(_key(group, m, 0, F.substr(s, F.lit(1), a)).alias("k"), F.substr(s, a + 1).alias("rest"))))
        out.append(F.when(able, F.struct(_key(group, m, 1, F.substr(s, n - tail + 1, tail)).alias("k"), F.substr(s, F.lit(1), n - tail).alias("rest"))))
    return F.array_compact(F.array(*out))


ANY_LENGTH, SHORTER, EQUAL, LONGER = 7, 1, 2, 4


def _meet(index: DataFrame, probe: DataFrame, cuts: int, hot_forms: int) -> DataFrame:
    """(a, b) candidates that share a segment. A segment of more than ``hot_forms`` indexed forms is no key of its
    own: the words under it are cut again at the rest, for an edit that the segment does not have lies there."""
    keyed = index.select(F.col("form").alias("a"), F.explode(segments(F.col("grp"), F.col("s"))).alias("x")).select("a", "x.k", "x.rest")
    wanted = probe.select(F.col("form").alias("b"), F.explode(lookups(F.col("grp"), F.col("s"), F.col("lengths"))).alias("x")).select("b", "x.k", "x.rest")
    if cuts:
        hot = settle_table(keyed.groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") > hot_forms).select("k"), "hot")
        if hot.head(1):
            deeper = [side.join(hot, "k", "left_semi").select(F.col(c).alias("form"), F.col("k").alias("grp"), F.col("rest").alias("s"), F.lit(ANY_LENGTH).alias("lengths")) for side, c in ((keyed, "a"), (wanted, "b"))]
            cold = keyed.join(hot, "k", "left_anti").join(wanted.select("b", "k"), "k").select("a", "b")
            return cold.unionByName(_meet(*deeper, cuts - 1, hot_forms))
    return keyed.select("a", "k").join(wanted.select("b", "k"), "k").select("a", "b")


def near_pairs(index: DataFrame, probe: DataFrame, hot_forms: int = HOT_FORMS) -> DataFrame:
    """(a, b): pairs of an indexed and a probing form in the same group whose strings are one edit apart or equal.
    Both inputs have (form, grp, s); their rows hold form, group and string as one key, so that hits bring these
    along and nothing is joined back. Groups may have a middle part, whose strings must be near, too."""

    @F.arrow_udf(T.BooleanType())
    def verified(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array([all(within_one(p, q) for p, q in zip(a.split("\x1d")[1:], b.split("\x1d")[1:])) for a, b in zip(x.to_pylist(), y.to_pylist())])

    def whole(rows: DataFrame) -> DataFrame:
        g = [F.col("g")] if "g" in rows.columns else []
        lengths = F.col("lengths") if "lengths" in rows.columns else F.lit(ANY_LENGTH)
        return rows.select(F.concat_ws("\x1d", "form", *g, "s").alias("form"), "grp", "s", lengths.alias("lengths"))

    hits = _meet(whole(index), whole(probe), HOT_CUTS, hot_forms)
    # A cheap bound first: one edit is two at most where a swap counts as two, in each of two words.
    words = [F.substr(c, F.instr(c, "\x1d") + 1) for c in "ab"]
    near = hits.where(F.levenshtein(*words, 4) >= 0).where(verified("a", "b"))
    return near.select(*(F.substring_index(c, "\x1d", 1).alias(c) for c in "ab")).where("a <> b").distinct()


def by_given(names: DataFrame, lengths: int | None = None, surname_lengths: int = ANY_LENGTH) -> DataFrame:
    """Full names (form, g, s) under the segments of their given name, as groups in which surnames meet; under the
    segments that it looks up where ``lengths`` are given."""
    cut = segments(F.lit(""), F.col("g")) if lengths is None else lookups(F.lit(""), F.col("g"), F.lit(lengths))
    keys = F.explode(F.array_distinct(F.transform(cut, lambda x: x["k"]))).alias("k")
    return names.select("form", "g", keys, "s").select("form", "g", F.concat(F.lit("P"), "k").alias("grp"), "s", F.lit(surname_lengths).alias("lengths"))


def near_names(index: DataFrame, probe: DataFrame, hot_forms: int = HOT_FORMS) -> DataFrame:
    """(a, b): full names (form, g, s) whose given names and surnames are each one edit apart or equal."""
    return near_pairs(by_given(index), by_given(probe, ANY_LENGTH), hot_forms)


def no_slips_of_names(pairs: DataFrame, names: DataFrame, known: frozenset[str] = frozenset()) -> DataFrame:
    """The pairs (a, b, ga, sa, gb, sb) of near names but those in which two words differ that are both names of
    their own: both ``known`` given names, both in many different names, or given names that only their last letter
    tells apart (Jan, Jane) and of which neither is known."""

    @F.arrow_udf(T.BooleanType())
    def slip(x: pa.Array, y: pa.Array) -> pa.Array:
        out = []
        for a, b in zip(x.to_pylist(), y.to_pylist()):
            n = max(len(a), len(b)) - 1
            ending = a[:n] == b[:n]
            out.append(a == b or ((a in known) != (b in known)) or not (a in known or ending))
        return pa.array(out)

    def word(side: str, w: str) -> Column:
        return F.struct(F.lit(side).alias("side"), F.col(w).alias("w"))

    own = names.select(F.explode(F.array(word("g", "g"), word("s", "s"))).alias("x")).groupBy("x.side", "x.w").agg(F.count("*").alias("n"))
    both = F.filter(F.array(*(F.struct(F.lit(side).alias("side"), F.col(f"{side}{c}").alias("w"), (F.col(f"{side}a") != F.col(f"{side}b")).alias("differ")) for side in "gs" for c in "ab")), lambda x: x["differ"])
    each = pairs.where(slip("ga", "gb")).select("a", "b", F.explode_outer(both).alias("x")).select("a", "b", "x.side", "x.w")
    counted = each.join(own, ["side", "w"], "left").groupBy("a", "b", "side").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    fine = F.col("side").isNull() | (F.col("least") < NAME_FROM) | (F.col("least") * SLIP_TIMES <= F.col("most"))
    return counted.groupBy("a", "b").agg(F.min(fine).alias("fine")).where("fine").select("a", "b")


def same_firm(a: str, b: str) -> bool:
    """Whether the words of two names pair off as equal, one edit apart or abbreviations."""
    x, y = a.split(" "), b.split(" ")
    if len(x) != len(y):
        return False
    for w in sorted(x, key=len, reverse=True):
        fits = [v for v in y if v == w] or [v for v in y if shortens(v, w) or shortens(w, v) or (len(w) >= WORD_EDIT_FROM and within_one(v, w))]
        if not fits:
            return False
        y.remove(fits[0])
    return True


def brief_keys(word: str) -> list[str]:
    """The first ``BRIEF`` letters of all that may abbreviate ``word``."""
    rest = [c for c in word[1:] if c not in "aeiou"]
    cut = {word[:n] for n in range(2, BRIEF + 1)} | {word[0] + "".join(c) for n in range(1, BRIEF) for c in combinations(rest, n)}
    return sorted(k for k in cut if 2 <= len(k) < len(word))


def abbreviated(firms: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b): names of firms (form, s) and other spellings that share a word and whose other words may abbreviate the
    firm's or be abbreviated by them. They meet at the firm's rare words and its rarest. A spelling without any of these
    has another word for the rarest, and meets the firm at the common word with what that other word may be."""
    k, words = F.size(F.split("s", " ")).alias("k"), F.explode(F.array_distinct(F.split("s", " "))).alias("w")
    tokens = firms.select("form", "s", k, words)
    counts = settle_table(tokens.groupBy("w").agg(F.count("*").alias("n")), "firm-words")
    of_form = Window.partitionBy("form")  # the words of one name
    ranked = tokens.join(counts, "w").withColumn("rarest", F.min(F.struct("n", "w")).over(of_form))
    left = ranked.where(f"n = rarest.n or n <= {RARE_FIRMS}").select(F.col("form").alias("a"), F.col("s").alias("sa"), "k", "w")
    right = texts.select(F.col("form").alias("b"), F.col("s").alias("sb"), k, words)

    @F.arrow_udf(T.BooleanType())
    def same(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array([same_firm(p, q) for p, q in zip(x.to_pylist(), y.to_pylist())])

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def keys(x: pa.Array) -> pa.Array:
        return pa.array([brief_keys(w) for w in x.to_pylist()], pa.list_(pa.string()))

    def meeting(rows: DataFrame, short: str, full: str) -> DataFrame:
        brief = F.when(F.length("s") > 1, F.array(F.concat(F.lit(short), F.substr("s", F.lit(1), F.lit(BRIEF)))))
        long = F.transform(keys("s"), lambda x: F.concat(F.lit(full), x))
        return rows.select("form", "grp", F.explode(F.concat(F.coalesce(brief, F.array().cast("array<string>")), long)).alias("key"))

    met = left.join(right, ["w", "k"]).where("a <> b and k > 1").select("a", "b", "sa", "sb").distinct()
    common = counts.where(F.col("n") > RARE_FIRMS).select("w")
    if common.head(1):
        grp = F.concat_ws("\x1f", "w", F.col("k").cast("string")).alias("grp")
        index = ranked.where(f"n > rarest.n and n > {RARE_FIRMS} and k > 1").select(F.concat_ws("\x1d", "form", "s", "rarest.w").alias("form"), grp, F.col("rarest.w").alias("s"))
        probe = right.where("k > 1").join(common, "w", "left_semi").select(F.concat_ws("\x1d", "b", "sb").alias("form"), grp, F.explode(F.array_distinct(F.split("sb", " "))).alias("s"))
        brief = meeting(index, "<", ">").withColumnRenamed("form", "a").join(meeting(probe, ">", "<").withColumnRenamed("form", "b"), ["grp", "key"]).select("a", "b")
        slips = _meet(index.where(F.length("s") >= WORD_EDIT_FROM), probe.withColumn("lengths", F.lit(ANY_LENGTH)), HOT_CUTS, HOT_FORMS)
        x, y = F.split("a", "\x1d"), F.split("b", "\x1d")
        far = brief.unionByName(slips).select(x[0].alias("a"), y[0].alias("b"), x[1].alias("sa"), y[1].alias("sb"), x[2].alias("r"))
        far = far.where("a <> b and not array_contains(split(sb, ' '), r)").drop("r").distinct()
        met = met.unionByName(far).distinct()
    return met.where(same("sa", "sb")).select("a", "b")


def _learn(entities: DataFrame) -> tuple[list[str], list[str], list[tuple[str, str]]]:
    """Given names, business words, and (word, fuller word) that stand for each other. Each is bounded by the share
    of all names, or of all rows that show such a pair, which it needs."""
    none = F.array().cast("array<string>")
    rows = entities.where("name is not null and kind in ('person', 'org')").select("kind", "name", F.coalesce("aliases", none).alias("aliases"))

    def tokens_of(spelling: str) -> tuple[str, ...]:
        tokens = [t for t in _SPLIT.split(fold(_DECOR.sub(" ", spelling)).replace("&", " ")) if t and t not in LEGAL and t not in TITLES and (len(t) > 1)]
        return tuple(tokens)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for kind, name, aliases in zip(*(c.to_pylist() for c in batch.columns)):
                tokens = tokens_of(name)
                if kind == "person" and len(tokens) == 2 and "," not in name:
                    out.append(("g", tokens[0], tokens[1]))
                if kind == "org" and len(tokens) > 1:
                    out += [("o", t, " ".join(x for x in tokens if x != t)) for t in tokens if len(t) > 3]
                # Words in whose place spellings of one row have another, both within the same other words.
                shown: dict[tuple[str, ...], list[str]] = {}
                for spelling in dict.fromkeys((name, *aliases)):
                    ts = tuple(sorted(set(tokens_of(spelling)))) if spelling else ()
                    if 2 <= len(ts) <= 12:
                        for k, t in enumerate(ts):
                            shown.setdefault((*ts[:k], *ts[k + 1 :]), []).append(t)
                for rest, words in shown.items():
                    first, *others = dict.fromkeys(words)
                    out += [("a", "\t".join(sorted((first, w))), " ".join(rest)) for w in others if not within_one(first, w)]
            yield pa.record_batch([pa.array(c, pa.string()) for c in (zip(*out) if out else ([], [], []))], names=["what", "word", "rest"])

    counts = settle_table(rows.mapInArrow(count, "what string, word string, rest string").distinct().groupBy("what", "word").agg(F.count("*").alias("n")), "words")
    of = {r["what"]: (r["total"], r["most"]) for r in counts.groupBy("what").agg(F.sum("n").alias("total"), F.max("n").alias("most")).collect()}

    least = {}
    for what, count_from, share, of_most in (("g", LEARNED_FROM, GIVEN_SHARE, 0.0), ("o", LEARNED_FROM, BUSINESS_SHARE, OF_MOST), ("a", STAND_FROM, STAND_SHARE, 0.0)):
        total, most = of.get(what, (0, 0))
        least[what] = max(count_from, share * total, of_most * most)
    enough = F.lit(False)
    for what, n in least.items():
        enough = enough | ((F.col("what") == what) & (F.col("n") >= n))
    taught: dict[str, list[str]] = {"g": [], "o": [], "a": []}
    for r in counts.where(enough).select("what", "word").collect():
        taught[r.what].append(r.word)
    givens, business, pairs = taught["g"], taught["o"], [tuple(p.split("\t")) for p in taught["a"]]
    words = sorted({w for p in pairs for w in p})
    often = {r["word"]: r["n"] for r in counts.where((F.col("what") != "a") & F.col("word").isin(words)).groupBy("word").agg(F.sum("n").alias("n")).collect()} if words else {}
    fuller = [(a, b) if (often.get(a, 0), len(a), a) < (often.get(b, 0), len(b), b) else (b, a) for a, b in pairs]
    return sorted(givens), sorted(business), sorted(fuller)


def spellings(entities: DataFrame, items: DataFrame, exports: DataFrame) -> DataFrame:
    """(key, spelling, kind): the names and aliases of persons and organisations, and the distinct senders but the
    owners."""
    people = entities.where("id is not null and kind in ('person', 'org')")
    names = people.select(F.concat(F.lit("e:"), "id").alias("key"), F.explode(F.array_compact(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("spelling"), "kind")
    senders = items.where("sender is not null").groupBy("sender").agg(F.lit(1).alias("one"))
    owners = exports.where("owner is not null").select(F.col("owner").alias("plain")).distinct()

    @F.arrow_udf("string")
    def plain(x: pa.Array) -> pa.Array:
        return pa.array([repair(s) or s for s in x.to_pylist()], pa.string())

    others = senders.withColumn("plain", plain("sender")).join(owners, "plain", "left_anti")
    return names.unionByName(others.select(F.concat(F.lit("s:"), "sender").alias("key"), F.col("sender").alias("spelling"), F.lit(None).cast("string").alias("kind")))


def linked(entities: DataFrame, items: DataFrame, exports: DataFrame) -> DataFrame:
    """(key, component): entity rows and senders by the person or organisation they denote; senders only where an
    entity row denotes the same."""
    reader = Reader(*_learn(entities))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, spelling, kind in zip(*(c.to_pylist() for c in batch.columns)):
                made = reader.forms(spelling, kind)
                out += [(key, *form, True) for form in made]
                if last := reader.fallback(spelling):
                    out.append((key, *last, kind != "org" and any(t == "p" for t, _, _ in made)))
            columns = list(zip(*out)) if out else [()] * 5
            yield pa.record_batch([*(pa.array(c, pa.string()) for c in columns[:4]), pa.array(columns[4], pa.bool_())], names=["key", "t", "g", "s", "person"])

    # A full name in either order, and a name written in one word and words written together, are one form where equal.
    form = F.concat_ws("\x1e", F.when(F.col("t").isin("u", "k"), "h").when(F.col("t") == "r", "p").otherwise(F.col("t")), "g", "s").alias("form")
    forms = settle_table(spellings(entities, items, exports).mapInArrow(read, "key string, t string, g string, s string, person boolean").select("*", form), "read")
    # Words written together under a short form only matter where a name in one word is the same.
    one_word = forms.where("t = 'u'").select("s").distinct()
    forms = forms.where("t not in ('k', 'v')").unionByName(forms.where("t in ('k', 'v')").join(one_word, "s", "left_semi"))
    every = settle_table(forms.groupBy("key", "t", "g", "s", "form").agg(F.min("person").alias("person")), "forms")
    nodes = settle_table(every.where("t in ('p', 'r', 'o', 'h', 'u', 'i')").groupBy("form", "t", "g", "s").agg(F.lit(1).alias("one")).drop("one"), "form-nodes")
    people = nodes.where("t in ('p', 'r')").groupBy("form", "g", "s").agg(F.min("t").alias("t"))
    short = every.where("t = 'q'").select(F.split("g", "\t").alias("g"), "s").distinct()
    short = short.select(F.concat_ws("\x1e", F.lit("q"), F.col("g")[1], "s", F.col("g")[0]).alias("form"), F.col("g")[1].alias("g"), "s")
    words = every.where("t = 'w'")
    texts = words.groupBy("form", "s", "g").agg(F.min("person").alias("person"))

    # All that is looked for an edit apart, in one join: full names, firms, initials and surnames, names written in one
    # word, and sorted words where one is no full name of a person (the full names of relatives may be so near). Of
    # two full names the one with the shorter given name, or surname, looks up the other.
    t, g, s, first = F.col("t"), F.col("g"), F.col("s"), F.substr("g", F.lit(1), F.lit(1))

    def sought(grp: Column, middle: Column = F.lit(""), lengths: int = ANY_LENGTH) -> Column:
        return F.struct("form", middle.alias("g"), grp.alias("grp"), "s", F.lit(lengths).alias("lengths"))

    def full(cut: Column, lengths: int = ANY_LENGTH) -> Column:
        return F.transform(F.array_distinct(F.transform(cut, lambda x: x["k"])), lambda k: sought(F.concat(F.lit("P"), k), g, lengths))

    def cases(person: Column, initial: str, handle: str) -> Column:
        firm = F.when((t == "o") & (F.length(s) >= WORD_EDIT_FROM), F.array(sought(F.concat(F.lit("O"), g))))
        firm = firm.when((t == handle) & (F.length(s) >= JOINED_EDIT_FROM), F.array(sought(F.lit("H"))))
        return F.coalesce(F.when(t.isin("p", "r"), person), firm.when(t == initial, F.array(sought(F.concat(F.lit("I"), g)))))

    def words_of(rows: DataFrame) -> DataFrame:
        return rows.where(F.length("s") >= WORD_EDIT_FROM).select(sought(F.concat(F.lit("W"), g)).alias("x")).select("x.*")

    no = F.lit("")
    index = nodes.select(F.explode(cases(F.concat(full(segments(no, g)), F.array(sought(F.concat(F.lit("I"), first)))), "", "h")).alias("x")).select("x.*")
    twice = F.concat(full(lookups(no, g, F.lit(LONGER))), full(lookups(no, g, F.lit(EQUAL)), EQUAL | LONGER))
    probe = nodes.select(F.explode(cases(twice, "i", "u")).alias("x")).select("x.*").unionByName(by_given(short, ANY_LENGTH))
    index, probe = index.unionByName(words_of(texts)), probe.unionByName(words_of(texts.where("not person")))
    hits = settle_table(near_pairs(index, probe), "near")
    kind = [F.substring_index(c, "\x1e", 1) for c in "ab"]
    part = {f"{side}{c}": F.element_at(F.split(c, "\x1e"), k) for c in "ab" for side, k in (("g", 2), ("s", 3))}
    near = hits.where((kind[0] == "p") & (kind[1] == "p")).select("a", "b", *(x.alias(name) for name, x in part.items()))
    # Orders are met as written, or one as written with one turned: Jan Orlov and Jane Orlov turned differ in a surname.
    straight = people.select("form", (F.col("t") == "p").alias("written"))
    near = near.join(straight.select(F.col("form").alias("a"), F.col("written").alias("wa")), "a").join(straight.select(F.col("form").alias("b"), F.col("written").alias("wb")), "b").where("wa or wb").drop("wa", "wb")
    one_name = no_slips_of_names(near, people, frozenset(reader.formal)).unionByName(hits.where((kind[0] == "o") & (kind[1] == "o") & (F.col("a") < F.col("b"))))
    # A short form of several names is the one of them that stands with this surname, or else with one an edit apart.
    fits = hits.where((kind[0] == "p") & (kind[1] == "q") & (part["ga"] == part["gb"]))
    fits = fits.select("a", part["ga"].alias("ga"), (part["sa"] != part["sb"]).alias("d"), F.concat_ws("\x1e", F.lit("p"), F.element_at(F.split("b", "\x1e"), 4), part["sb"]).alias("b")).where("a <> b")
    fits = fits.groupBy("b", "d").agg(F.count_distinct("ga").alias("n"), F.collect_set("a").alias("a"))
    fits = fits.groupBy("b").agg(F.min_by(F.struct("n", "a"), "d").alias("x")).where("x.n = 1").select(F.explode("x.a").alias("a"), "b")
    one_name = one_name.unionByName(fits)
    met = hits.where(kind[0] == "h").select(F.col("a").alias("form")).unionByName(every.where("t = 'u'").select("form")).distinct()
    together = every.where("t = 'h'").join(met, "form", "left_semi")
    member = every.where("t in ('p', 'r', 'o', 'x', 'k', 'u')").unionByName(together).select(F.col("key").alias("a"), F.col("form").alias("b"))
    parts = components(member.unionByName(one_name))
    vertex = F.col("vertex")
    with_entity = parts.where(vertex.startswith("e:")).select("component").distinct()
    part_of_form = settle_table(parts.join(with_entity, "component", "left_semi").select(vertex.alias("f"), "component"), "parts")
    # What fits more than one name joins where the nearest that fit are one component: initials the full names whose
    # given name begins so, and names in one word full names written together.
    initial = nodes.where("t = 'i'").select("form", F.col("g").alias("grp"), "s")
    same = initial.join(people.select(F.col("form").alias("f"), "s", first.alias("grp")), ["s", "grp"]).select(F.col("form").alias("i"), "f", F.lit(0).alias("d"))
    # Not the surname alone, whose first letter was taken for an initial.
    slipped = hits.where(((kind[0] == "p") & (kind[1] == "i") & (F.concat(part["gb"], part["sb"]) != part["sa"]) & (part["sa"] != part["sb"])) | ((kind[0] == "h") & (kind[1] == "h")))
    reached = same.unionByName(slipped.select(F.col("b").alias("i"), F.col("a").alias("f"), F.lit(1).alias("d"))).join(part_of_form, "f").select("i", "d", "component")
    one_word = every.where("t in ('i', 'u')").select("key", F.concat("g", "s").alias("s"), F.col("form").alias("i"))
    candidates = one_word.join(reached, "i").select("key", "s", "d", "component")
    written = every.where("t = 'v'").select("s", F.col("key").alias("f")).join(part_of_form, "f").select("s", "component").distinct()
    candidates = candidates.unionByName(every.where("t = 'u'").select("key", "s").join(written, "s").select("key", "s", F.lit(0).alias("d"), "component"))
    nearest = candidates.groupBy("key", "s", "d").agg(F.count_distinct("component").alias("n"), F.min("component").alias("component"))
    chosen = nearest.groupBy("key", "s").agg(F.min(F.struct("d", "n", "component")).alias("x")).where("x.n = 1").select("key", F.col("x.component").alias("component"))
    is_key = F.col("f").startswith("e:") | F.col("f").startswith("s:")
    placed = part_of_form.where(is_key).select("component", F.col("f").alias("key"))
    # A key whose part has no full name yet gets the one that fits; any other keeps its part.
    named = part_of_form.where(F.col("f").startswith("p\x1e") | F.col("f").startswith("o\x1e")).select("component").distinct()
    chosen = chosen.join(placed.join(named, "component", "left_semi").select("key"), "key", "left_anti").groupBy("key").agg(F.min("component").alias("component"))
    # Each set of edges is written by itself: in one plan with all that leads to them their stages would run at once, and
    # the driver would hold a hundred exchanges. (Not the ranked words of firms: what is as small as that on disk and
    # many times as large in memory would be broadcast.)
    placed = settle_table(placed.unionByName(chosen.select("component", "key")), "placed")
    # What the readings leave apart meets by its words: equal ones, ones an edit apart, and those of firms cut short.
    edges = placed.select(F.col("key").alias("a"), F.concat(F.lit("c:"), "component").alias("b")).unionByName(words.select(F.col("key").alias("a"), F.col("form").alias("b")))
    of_firms = every.where("t = 'o'").select("key").distinct()
    firm_words = settle_table(words.join(of_firms.where(F.col("key").startswith("e:")), "key", "left_semi").select("form", "s").distinct(), "firms")
    short_words = settle_table(abbreviated(firm_words, texts), "short-words")
    whole = settle_table(components(edges.unionByName(hits.where((kind[0] == "w") & (kind[1] == "w"))).unionByName(short_words)), "whole")
    own = whole.where(vertex.startswith("e:") | vertex.startswith("s:")).select(vertex.alias("key"), "component")
    placed = own.join(own.where(F.col("key").startswith("e:")).select("component").distinct(), "component", "left_semi").select("component", "key")
    # What many may bear joins if one person or firm bears it.
    shared = every.where("t = 'n'").select("key", "form")
    bearers = shared.where(F.col("key").startswith("e:")).join(placed, "key", "left").withColumn("component", F.coalesce("component", "key"))
    sole = bearers.groupBy("form").agg(F.count_distinct("component").alias("n"), F.min("component").alias("component")).where("n = 1")
    joining = shared.join(sole, "form").join(placed.select("key"), "key", "left_anti").groupBy("key").agg(F.min("component").alias("component"))
    return placed.unionByName(joining.select("component", "key"))


def found(entities: DataFrame, items: DataFrame, exports: DataFrame) -> DataFrame:
    rows = settle_table(linked(entities, items, exports).select("key", "component").distinct(), "linked")
    left = rows.where(F.col("key").startswith("e:")).select(F.col("key").alias("key_a"), "component")
    both = left.join(rows.select(F.col("key").alias("key_b"), "component"), "component")
    return both.where("key_a < key_b").select("key_a", "key_b").distinct()
