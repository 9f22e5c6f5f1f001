import hashlib

import pytest

from quillon.llm import encoding as E

SOUND = ["Größe und Ärger", "¿Puedes traer 31 sillas? Sí, señor.", "Я оставил ключ у Ewa в городе.", "我把钥匙留在这里了。", "会議は6:12に始まります。", "Ο σκύλος ζυγίζει 7 κιλά", "She said “Wait.” and left…", "naïve café déjà vu", "Zoë 🎸"]
TRAPS = ["To type Ã you press two keys", "├── keys and └── maps", "√65 is no whole number", "NÃO ESQUEÇA AS CHAVES! A MINHA IRMÃ JÁ CHEGOU", "Âgé de 5 ans", "Brâjimomi", " Zoë\xa0\xa0H", "чай и сахар", "plain ascii", "Ž š ž Œ", "50 €", ""]


@pytest.mark.parametrize("text", SOUND + TRAPS)
def test_clean_texts_stay(text):
    assert E.repair(text) is None


def through(text, right, wrong):
    out = bytearray(text.encode(right))
    return "".join(bytes([b]).decode(wrong) if (wrong != "cp1252" or b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)) else chr(b) for b in out) if wrong not in ("gb18030",) else None


@pytest.mark.parametrize("wrong", ["latin-1", "cp1252", "cp437", "cp850", "mac_roman"])
@pytest.mark.parametrize("text", SOUND)
def test_utf8_round_trips(text, wrong):
    assert E.repair(through(text, "utf-8", wrong)) == text


@pytest.mark.parametrize("text,right,wrong", [(SOUND[2], "cp1251", "latin-1"), (SOUND[2], "koi8-r", "cp1251"), (SOUND[3], "gb18030", "latin-1"), (SOUND[4], "cp932", "cp1252"), (SOUND[4], "cp932", "latin-1")])
def test_other_origins(text, right, wrong):
    assert E.repair(through(text, right, wrong)) == text


@pytest.mark.parametrize("text", ["für", "très", "hôtel", "fährt", "für für für für", "для меня", "会議"])
@pytest.mark.parametrize("wrong", E.WRONG_FOR_UTF8)
def test_every_encoding_competes(text, wrong):
    if (text[0], wrong) != ("f", "iso8859-2") or "ä" in text:  # 'fĂźr' is 'fßr' under cp1250 at the same cost
        chars = E._char_of(wrong)
        assert E.repair("".join(chars.get(b, chr(b)) for b in text.encode())) == text


@pytest.mark.parametrize("sound", ["🎵", "你"])
@pytest.mark.parametrize("text", ["très", "hôtel", "fährt", "łódź", "для меня"])
@pytest.mark.parametrize("wrong", E.WRONG_FOR_UTF8)
def test_parts_of_every_encoding(text, wrong, sound):
    chars = E._char_of(wrong)
    assert E.repair("".join(chars.get(b, chr(b)) for b in text.encode()) + " " + sound) == f"{text} {sound}"


def test_parts_of_other_origin():
    assert E.repair(through(SOUND[2], "cp1251", "latin-1") + " 🎵") == SOUND[2] + " 🎵"
    assert E.repair("её моё твоё ряд рад 🎵") is None


def test_layers_parts_and_losses():
    twice = through(through(SOUND[0], "utf-8", "latin-1"), "utf-8", "cp1252")
    assert E.repair(twice) == SOUND[0]
    assert E.repair("A minha irmÃ£ nÃ£o gosta de café") == "A minha irmã não gosta de café"
    assert E.repair("pr�s de") == "" and E.repair(None) is None
    long = "Größe " * 30_000
    assert E.repair(through(long, "utf-8", "latin-1")) == long


def test_found(spark):
    bad = through("Größe", "utf-8", "latin-1")
    rows = [("a", bad, bad, "x"), ("a", bad, bad, "x"), ("b", "fine", None, "x"), ("c", None, "Zo� x", "x"), (None, bad, bad, "x"), ("d", "Größe", "", "x")]
    df = spark.createDataFrame(rows, "id string, body string, sender string, text string")
    md5 = hashlib.md5("Größe".encode()).hexdigest()
    assert {tuple(r) for r in E.found(df).collect()} == {("a", "body", md5), ("a", "sender", md5), ("c", "sender", "")}
    assert E.found(df.limit(0)).count() == 0


def test_all_candidates_are_followed():
    """No candidate of a nested layer is dropped: what is cheap in the end may look worse than many others first."""
    for text in ("Żółć", "příliš žluťoučký", "smörgåsbord 🎉", "日本語のテキスト", "naïve café — “très”"):
        for first in ("latin-1", "cp1252"):
            for second in ("cp437", "mac_roman", "cp850", "latin-1"):
                try:
                    once = text.encode().decode(first)
                    twice = once.encode().decode(second)
                except UnicodeError:
                    continue
                assert E.repair(twice) == text, (text, first, second)
