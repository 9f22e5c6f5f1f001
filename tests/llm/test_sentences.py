import pytest

from quillon.llm import sentences as S

CASES = [
    ("Dr. Ann moved it to 9:06 p.m. Friday. It ended at 1:54 p.m. Tell Bo.", None, ["Dr. Ann moved it to 9:06 p.m. Friday.", "It ended at 1:54 p.m.", "Tell Bo."]),
    ("She asked, \"Who took it?\" before lunch. The note read: \"Gone. Back soon.\" Then rain.", None, ["She asked, \"Who took it?\" before lunch.", "The note read: \"Gone. Back soon.\"", "Then rain."]),
    ("We paid 3.5 per jar. Version 2.4.1 of x.y broke! Really?! 55 people came.", None, ["We paid 3.5 per jar.", "Version 2.4.1 of x.y broke!", "Really?!", "55 people came."]),
    ("No. 6 is done. No. I stay. See p. 12, etc. Then go.", None, ["No. 6 is done.", "No.", "I stay.", "See p. 12, etc.", "Then go."]),
    ("Am 21. August ziehen wir um. Wir haben z. B. Käse. Die 2. Etage ist frei.", None, ["Am 21. August ziehen wir um.", "Wir haben z. B. Käse.", "Die 2. Etage ist frei."]),
    ("Il dit : « Viens. Vite. » avant midi. Quelle journée ! Oui.", None, ["Il dit : « Viens. Vite. » avant midi.", "Quelle journée !", "Oui."]),
    ("Viajó a EE. UU. con Ana. ¿Sí? ¡No!", None, ["Viajó a EE. UU. con Ana.", "¿Sí?", "¡No!"]),
    ("В 2019 г. мы жили там. Это было в 2021 г. На ул. Садовой тихо.", None, ["В 2019 г. мы жили там.", "Это было в 2021 г.", "На ул. Садовой тихо."]),
    ("他说“明天再来吧！”就走了。谁忘了关门？ 📷 好的。", None, ["他说“明天再来吧！”就走了。", "谁忘了关门？ 📷", "好的。"]),
    ("「もう着いた。待ってる。」と書いた。はい。", None, ["「もう着いた。待ってる。」と書いた。", "はい。"]),
    ("Πού είναι; Ο κ. Ann ήρθε. A; B", None, ["Πού είναι;", "Ο κ. Ann ήρθε.", "A; B"]),
    ("मुझे चाय पसंद है। डॉ. Ann ने कहा। क्या?", None, ["मुझे चाय पसंद है।", "डॉ. Ann ने कहा।", "क्या?"]),
    ("أين الصور؟ د. Ann غيّر الموعد. نعم.", None, ["أين الصور؟", "د. Ann غيّر الموعد.", "نعم."]),
    ("หมาหนัก 9.5 กิโลแล้วครับ รถไฟมาช้าค่ะ", None, ["หมาหนัก 9.5 กิโลแล้วครับ", "รถไฟมาช้าค่ะ"]),
    ("ቁልፉን ሰጠሁ። የት ናቸው?", None, ["ቁልፉን ሰጠሁ።", "የት ናቸው?"]),
    ("Me: Hi. Go\r\nDr. Bo: ok 🙂\n\n🙂", "sms", ["Me: Hi.", "Go", "Dr. Bo: ok 🙂", "🙂"]),
    ("Dear Ann,\n\nWe paid for the\nsofa. It rained\nlong.\n \nBye", "letter", ["Dear Ann,", "We paid for the\nsofa.", "It rained\nlong.", "Bye"]),
    ("1. One. Two\n- Three!\n• 4 x tea", "profile", ["1. One.", "Two", "- Three!", "• 4 x tea"]),
    ("Well... maybe. Wait… Now", None, ["Well... maybe.", "Wait…", "Now"]),
]


@pytest.mark.parametrize("text,source,want", CASES)
def test_cases(text, source, want):
    assert [text[a:b] for a, b in S.sentences(text, source)] == want


def test_edges(spark):
    assert S.sentences(None) == S.sentences("") == S.sentences(" \n\t") == []
    long = "One more sentence here. " * 20_000
    assert len(S.sentences(long)) == 20_000
    unclosed = 'He said "wait. Then he left. Gone.'
    assert len(S.sentences(unclosed)) == 3
    rows = [(1, "Hi. Go", "diary", "q"), (2, None, None, "q"), (3, "", "x", "q"), (1, "Hi. Go", "diary", "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, word string")
    assert sorted(tuple(r) for r in S.split(df).collect()) == [(1, 0, 3), (1, 0, 3), (1, 4, 6), (1, 4, 6)]
    assert S.split(df.limit(0)).count() == 0


def test_corpus_counts_find_abbreviations(spark):
    rows = [(k, f"The qrst. Name number {k} came. We saw it\nIt ended. Again it ended.", "diary") for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert "qrst" in S.abbreviations(df) and "ended" not in S.abbreviations(df)
    assert min(r.sent_end for r in S.split(df).where("doc_id = 3 and sent_start = 0").collect()) > 20


@pytest.mark.parametrize("more", ["Heute kommt Jan nicht.", "Alle mögen Jan.\nGut."])
def test_document_overrules_lists(more):
    spans = lambda text, **k: [text[a:b] for a, b in S.sentences(text, **k)]
    assert spans(f"Ich traf Jan. Er ging. {more}")[:2] == ["Ich traf Jan.", "Er ging."]
    assert spans(f"Ich traf Jan. Er ging. {more}", never_last=frozenset({"Jan"}))[0] == "Ich traf Jan."
    assert spans("Ich traf Jan. Er ging.", often_last=frozenset({"Jan"}))[0] == "Ich traf Jan."
    assert spans("We met Dr Smith here. Then Dr. Jones left.") == ["We met Dr Smith here.", "Then Dr. Jones left."]
    assert spans("He saw Mary here.\nMain St.\nAt St. Mary it rained.")[2:] == ["At St. Mary it rained."]


def test_corpus_counts_overrule_the_list(spark):
    rows = [(k, f"Jan kam heute {k} mal\nWir trafen Jan.\nMit Jan und Eva", "diary") for k in range(30)]
    never, often = S.corpus_words(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert "Jan" in often and "Jan" not in never


def test_document_evidence_has_no_length_limit():
    spans = lambda text, *a: [text[x:y] for x, y in S.sentences(text, *a)]
    assert spans("We stopped at St.\nThey live on Main St. Then we left.") == ["We stopped at St.", "They live on Main St.", "Then we left."]
    assert spans("I got a M.\nShe chose M. Then he won.") == ["I got a M.", "She chose M.", "Then he won."]
    assert spans("Haus Nr. Eins ist da.") == ["Haus Nr. Eins ist da."]
    assert spans("The approximat. Value is low. An approximat. value and approximat. values.") == ["The approximat. Value is low.", "An approximat. value and approximat. values."]
    assert spans("we were there. then it rained there. and now there. Then sun, there") == ["we were there. then it rained there. and now there.", "Then sun, there"]
    label = "Anna " * 40
    assert spans(f"{label}: Hi. Go", "sms") == [f"{label}: Hi.", "Go"]
    assert spans("It works. We saw this: a cat. Go", "sms") == ["It works.", "We saw this: a cat.", "Go"]
