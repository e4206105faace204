import pytest

from conftest import rows_of
from quillmesh.llm import pairs as P
from quillmesh.llm.langid import language
from quillmesh.llm.truncation import cut_texts, length_limits, read_ending

ASK = "How do I rename the audit record in Velkin?"
ANSWER = "To rename the audit record in Velkin, open the settings and choose the record from the list. The change is saved at once."


@pytest.mark.parametrize("text", [None, "", " \n\t", "​ ", "N/A", "null", "None", "[empty]", "(no content)", "{}", "...", "-", "…"])
def test_empty(text):
    assert P.is_empty(text)


@pytest.mark.parametrize("text", ["Yes", "57 MB", "No", "0", "🙂", "true"])
def test_not_empty(text):
    assert not P.is_empty(text)


@pytest.mark.parametrize(("text", "want"), [(ASK, True), (f'"{ASK}"', True), (f"Q: {ASK}", True), (f"You asked: {ASK.upper()}", True), (f"{ASK}\n{ASK}", True), (f"{ASK} Good question. {ANSWER}", False), (ANSWER, False), ("Velkin", False)])
def test_copy(text, want):
    assert P.is_copy(ASK, text) is want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Sorry, I can't help with that.", (True, True)),
        ("Apologies — I have been instructed not to discuss Velkin. Please consult a qualified person.", (True, True)),
        ("Lamento, preciso recusar essa solicitação. Posso ajudar com outra coisa?", (True, True)),
        ("Lo siento, pero no puedo ayudarte con eso.", (True, True)),
        (f"Sorry for the delay earlier. {ANSWER} {ANSWER}", (False, False)),
        (f"I'm unable to confirm the exact build, so check the version first. {ANSWER}", (True, False)),
    ],
)
def test_decline(text, want):
    assert P.decline_parts(ASK, text)[:2] == want


def test_language():
    assert language("Where can I see the request filter that Tarvex writes every night?") == "en"
    assert language("Como faço para limitar a fila de revisão em Ivarno?") == "pt"
    assert language("¿Cómo puedo sustituir el cargador de documentos en Nimbrell?") == "es"
    assert language("Quand le compteur de jetons arrive à la fin, le service est prêt.") == "fr"
    assert language("Nach 37 Minuten speichert der Dienst die Preisliste.") == "de"
    assert language("Apri le impostazioni e scegli la voce che non è più nella lista.") == "it"
    assert language("Open de instellingen en kies het item dat niet in de lijst staat.") == "nl"
    assert [language(t) for t in ("設定を開いて記録を選んでください。", "Откройте настройки и выберите запись.", "설정을 열고 기록을 선택하세요", "打开设置并选择记录。")] == ["ja", "ru", "ko", "zh"]
    assert language("The letter α is used in the formula.") == "en"
    assert P.is_other_language(ASK, "設定を開いて、一覧から記録を選んでください。") and not P.is_other_language("設定はどこですか。", "設定を開いて、一覧から記録を選んでください。")
    assert not P.is_other_language("Me ayudas a renombrar la cola en el proyecto Velkin The e-mail field is required, but user@ alone is accepted.", "Para renombrar la cola, abre los ajustes y elige la opción.")
    assert language("") is None and language(None) is None and language("Hestrel") is None
    assert P.is_other_language(ASK, "Nach 37 Minuten speichert der Dienst die Preisliste und schreibt eine Zeile.")
    assert not P.is_other_language("Please answer in German: how do I rename it?", "Nach 37 Minuten speichert der Dienst die Preisliste und schreibt eine Zeile.")


@pytest.mark.parametrize(
    ("text", "state"),
    [
        (None, "blank"),
        (" ", "blank"),
        ("57 MB", "short"),
        ("All is well.", "whole"),
        ("All is well. Bye 🙂", "whole"),
        ("All is well. The rec…", "cut"),
        ("All is well. The rec</p>", "cut"),
        ("All is well. The rec�", "cut"),
        ("All is well. The records&nb", "cut"),
        ("All is well. The records are [...]", "cut"),
        ("See:\n```\nx = 1", "cut"),
        ("See:\n```\nx = 1\n```", "whole"),
        ("All is well. Before the end,", "cut"),
        ("Do:\n- Open it\n- ", "cut"),
        ("Do:\n- Open it\n- Close the door", "item"),
        ("All is well. Hope that helps", "prose"),
        ("All is well. This sentence has very many words and yet may be a closing phrase", "prose"),
    ],
)
def test_endings(text, state):
    assert read_ending(text)[0] == state


def test_cut_texts_by_corpus_and_limits(spark):
    rows = [(f"r{i}", "p", f"Text number {i} is whole. Hope that helps", f"q{i}", 1) for i in range(3)]
    rows += [(f"l{i}", "p", "Do it.\n- Open the review queue\n- Wait 5 minutes", f"q{i}", 1) for i in range(2)]
    rows += [("c1", "p", "Do it.\n- Wait 5 minutes\n- Open the rev", "a", 1), ("c2", "p", "Do it.\n- Wait 5 minutes\n- Open the review queue\n- Wait 7 minutes", "a", 1), ("c3", "p", "All is well. Open the settings of", "a", 1)]
    rows += [("n", "p", None, "a", 1), (None, "p", "x", "a", 1), ("e", None, "", None, 1)]
    rows += [(f"m{i}", "q", f"Item {i}. " + ("plain word " * 9)[:58] + " and the", f"q{i}", 1) for i in range(6)]
    df = spark.createDataFrame(rows, "id string, source string, text string, ask string, state int")
    got = dict(rows_of(cut_texts(df, "id", "source", "text", "ask"), "id", "is_cut"))
    assert {k for k, v in got.items() if v} == {"c1", "c3"} | {f"m{i}" for i in range(6)}
    assert cut_texts(df.limit(0), "id", "source", "text", "ask").count() == 0


def test_hidden_limit_in_another_measure(spark):
    rows = [("s", "word " * 12 + "x" * i) for i in range(40)]
    # Cut at 75 characters after entities are escaped: between 43 and 71 characters as stored.
    rows += [("s", "&" * k + "y" * (75 - 5 * k)) for k in range(1, 9)]
    df = spark.createDataFrame(rows, "source string, text string")
    got = length_limits(df, "source", "text", least=4).collect()
    assert any(r.measure.startswith("entity") and r.length_limit == 75 for r in got)


def test_pair_defects(spark):
    req = [("q1", ASK), ("q2", "¿Cómo puedo sustituir el cargador de documentos en Nimbrell?"), ("q3", None), ("q1", ASK), (None, "x")]
    res = [
        ("a", "q1", "p", ANSWER, "STOP"),
        ("a", "q1", "p", ANSWER, "STOP"),
        ("b", "q1", "p", None, "STOP"),
        ("c", "q1", "p", "", "tool_calls"),
        ("d", "q1", "p", f"Q: {ASK}", None),
        ("e", "q1", "p", "Sorry, I can't help with that.", "STOP"),
        ("f", "q2", "p", ANSWER, "STOP"),
        ("g", "q1", "p", ANSWER[:70], "STOP"),
        ("h", "nowhere", "p", ANSWER, "STOP"),
        ("i", "q3", None, "N/A", "STOP"),
        ("j", None, None, ANSWER[:71], "STOP"),
        (None, "q1", "p", None, "STOP"),
    ]
    requests = spark.createDataFrame(req, "request_id string, user_input string")
    responses = spark.createDataFrame(res, "response_id string, request_id string, provider_id string, content string, finish_reason string")
    got = dict(rows_of(P.pair_defects(responses, requests), "response_id", "defect"))
    assert got == {"b": "empty", "d": "copy", "e": "refusal", "f": "other_language", "g": "truncated", "i": "empty", "j": "truncated"}
    assert P.pair_defects(responses.limit(0), requests.limit(0)).count() == 0
    assert P.pair_defects(responses, requests.limit(0)).count() > 0


def test_a_recurring_wording_is_a_refusal_whatever_its_words(spark):
    topics = ["rename the audit record in Velkin", "export a price list", "limit the queue of Ivarno", "read the token counter", *[f"order item number {i}" for i in range(6)]]
    req = [(f"q{i}", f"How do I {t}?") for i, t in enumerate(topics)] + [("q9", ASK)]
    wording = "Thank you for asking. This desk keeps silent about every such matter."
    res = [(f"r{i}", f"q{i}", "p", wording, "STOP") for i in range(len(topics))]
    res += [(f"y{i}", f"q{i}", "p", "Only on weekdays.", "STOP") for i in range(len(topics))]
    res += [(f"o{i}", "q9", "p", "The silver lamp stands beside an old wooden gate.", "STOP") for i in range(4)]
    res += [("long", "q0", "p", f"{wording} {ANSWER} {ANSWER}", "STOP")]
    assert not any(P.decline_parts(None, x[3])[0] for x in res)
    requests = spark.createDataFrame(req, "request_id string, user_input string")
    responses = spark.createDataFrame(res, "response_id string, request_id string, provider_id string, content string, finish_reason string")
    got = dict(rows_of(P.pair_defects(responses, requests), "response_id", "defect"))
    assert got == {f"r{i}": "refusal" for i in range(len(topics))}


def test_a_recurring_phrase_on_a_limit_is_cut(spark):
    rows = [(f"r{i}", "p", "Note " + "abcdefghij"[i] * (60 - i) + "y" * i + " is saved. Then open the settings of", f"q{i}") for i in range(10)]
    rows += [(f"s{i}", "s", f"{'abcdefghij'[i] * 30} word of the", f"q{i}") for i in range(6)]
    rows += [(f"w{i}", "w", f"Text {'x' * 3 * i} is whole. Hope that helps", f"q{i}") for i in range(10)] + [("short", "w", "About 10 seconds", "q")]
    df = spark.createDataFrame(rows, "id string, source string, text string, ask string")
    got = dict(rows_of(cut_texts(df, "id", "source", "text", "ask"), "id", "is_cut"))
    assert {k for k, v in got.items() if v} == {f"r{i}" for i in range(10)} | {f"s{i}" for i in range(6)}


def test_every_limit_of_a_source_is_shown_in_its_measure(spark):
    rows = [("s", "é" * (i % 7) + f"{i:03d}" + "a" * (297 - i % 7)) for i in range(80)]
    # Fewer than half as many are cut at 500 bytes, at other numbers of characters.
    rows += [("s", "é" * (20 + 3 * i) + "b" * (460 - 6 * i)) for i in range(30)]
    rows += [("s", "word " * 12 + "x" * i) for i in range(40)]
    got = rows_of(length_limits(spark.createDataFrame(rows, "source string, text string"), "source", "text"), "measure", "length_limit", "n_texts")
    assert [x for x in got if x[0] == "chars"] == [("chars", 300, 80)] and len(got) == 2
    assert [x[1:] for x in got if x[0] != "chars"] == [(500, 30)] and got[1][0].endswith("bytes")


def test_evidence_and_limit_come_with_each_cut(spark):
    rows = [(f"m{i}", "q", f"Item {i}. " + ("plain word " * 9)[:58] + " and the", f"q{i}") for i in range(6)]
    rows += [("c", "p", "All is well. The rec…", "a"), ("w", "p", "To sort the ing", "a"), ("n", "p", "The ingest worker", "a"), ("t", "p", "To sort the ingest worker, wait. The ingest worker waits.", "a")]
    df = spark.createDataFrame(rows, "id string, source string, text string, ask string")
    got = {r.id: (r.evidence, r.measure, r.length_limit) for r in cut_texts(df, "id", "source", "text", "ask").collect()}
    assert all(got[f"m{i}"] == ("limit", "chars", 74) for i in range(6)), got
    assert got["c"] == ("ending", None, None) and got["w"] == ("corpus", None, None) and got["n"] == got["t"] == (None, None, None)


def test_a_long_closing_phrase_that_recurs_is_whole(spark):
    closing = "I hope that this short list of steps is of some help to you and yours"
    rows = [(f"r{i}", "p", f"Text {'x' * i} is done. {closing}", f"q{i}") for i in range(4)]
    rows += [("c", "p", "Text is done. The very long last sentence of this text has no end in the", "q")]
    got = dict(rows_of(cut_texts(spark.createDataFrame(rows, "id string, source string, text string, ask string"), "id", "source", "text", "ask"), "id", "is_cut"))
    assert {k for k, v in got.items() if v} == {"c"}


def test_the_filter_of_open_ends_only_lets_through(spark, monkeypatch):
    """However full the filter is, the result is the same."""
    from quillmesh.llm import truncation as T

    rows = [(f"t{i}", "p", f"Well. Open the settings of item {'abcdefgh'[i]} and wait.", "a") for i in range(8)] + [("c", "p", "All is well. Open the sett", "b"), ("d", "p", "All is well. Hope that helps", "b"), ("e", "p", "All is well. Hope that helps", "c")]
    df = spark.createDataFrame(rows, "id string, source string, text string, ask string")
    want = rows_of(cut_texts(df, "id", "source", "text", "ask"), "id", "is_cut")
    monkeypatch.setattr(T, "asked_filter", lambda keys: (b"\xff" * 4096, 1 << 15))
    assert rows_of(cut_texts(df, "id", "source", "text", "ask"), "id", "is_cut") == want and ("c", True) in want and ("d", False) in want


def test_longest_runs_are_exact():
    import random

    rng = random.Random(2)
    for _ in range(200):
        p, c = [[rng.choice("abc") for _ in range(rng.randrange(1, 30))] for _ in range(2)]
        i = 0
        for at, place, n in P.longest_runs(p, c, 3):
            assert c[at : at + n] == p[place : place + n]
            best = lambda k: max((m for s in range(len(p)) for m in [next((j for j in range(len(c)) if k + j >= len(c) or s + j >= len(p) or c[k + j] != p[s + j]), len(c))]), default=0)  # noqa: B023, E731
            assert n == best(at) and all(best(k) < 3 for k in range(i, at))
            i = at + n
    echo = "say it again and " * 300
    assert P.is_copy(echo + "then stop here please", "say it again and then stop here please " + echo)


def test_paraphrases_are_one_topic():
    assert P.topic("How do I rename the audit record?") == P.topic("how do I rename the AUDIT record") is not None
    assert P.topic(None) is None and P.topic("the of and") is not None


def test_a_long_stock_refusal_is_found_and_one_use_is_not(spark):
    """Seven sentences, none of them known to decline, given to unrelated prompts; a text used once is none."""
    topics = ["the audit record in Velkin", "a price list", "queue limits of Ivarno", "token counters", "old backups", "budget reports"]
    stock = "The matter you raise lies behind a closed door. " + " ".join(f"Every {w} thing about it stays where it is for now." for w in ("small", "great", "green", "early", "late", "quiet"))
    res = [(f"r{i}", f"q{i}", "p", stock, "STOP") for i in range(len(topics))] + [("one", "q0", "p", "This counter keeps silent about every such matter today.", "STOP")]
    requests = spark.createDataFrame([(f"q{i}", f"How do I manage {t}?") for i, t in enumerate(topics)], "request_id string, user_input string")
    responses = spark.createDataFrame(res, "response_id string, request_id string, provider_id string, content string, finish_reason string")
    got = dict(rows_of(P.pair_defects(responses, requests), "response_id", "defect"))
    assert got == {f"r{i}": "refusal" for i in range(len(topics))}
