import itertools
import random
import time

from plenaria.llm import transcripts as X


def show(raw, country="Germany", first=None):
    return [(no, who, n) for no, who, _, _, n, _ in X.turns(raw, country, first)]


def test_labels_of_all_styles_are_one_speaker():
    raw = "\n".join(
        ["[00:00:02] Jörg von Holstalau (VFE)", "Eins zwei.", "[00:00:05] HOLSTALAU: Drei.", "[00:00:07] >> VON HOLSTALAU: Vier.", "[00:00:09] von Holstalau, Jörg: Fünf.",
         "[00:00:11] J. von Holstalau (VFE): Sechs.", "[00:00:13] [Jörg von Hoslstalau] Sieben.", "[00:00:15] Holstalau (VFE) – Acht.", "[00:00:17] Präsidentin: Danke.", "[00:00:19] Neun."]
    )
    assert show(raw) == [(1, 1, 8), (2, 2, 2)]


def test_office_with_and_without_name_is_one_speaker():
    raw = "Präsidentin: Ich bitte.\nA. Berg (X): Ja.\nPräsidentin Müller-Lang: Danke.\n[Präsidentin] Weiter."
    assert show(raw) == [(1, 1, 2), (2, 2, 1), (3, 1, 2)]


def test_relatives_are_different():
    raw = "Jörg Sterseselihard: Ja.\nMareike Sterseselihard: Nein.\nM. Sterseselihard (GAL): Doch.\nJ. Sterseselihard (LKP): Gut."
    assert show(raw) == [(1, 1, 1), (2, 2, 2), (3, 1, 1)]


def test_sounds_times_and_hesitations_go_and_speech_stays():
    raw = "(00:10) Anna Berg: Ähm, um 17:50 Uhr – (Beifall bei der GAL) – stimmen wir (20/8840) <Lachen> öh... ab. *Unruhe* [Zurufe von der FWU]"
    _, _, _, text, n, _ = X.turns(raw, "Germany")[0]
    assert text == "Um 17:50 Uhr stimmen wir (20/8840) ab." and n == 9
    assert X.clean_all(["Ma ha e a, hm y", "yyy tak eeem, nie"], "Poland") == ["Ma ha e a, hm y", "Tak nie"]


def test_everything_said_stays_and_notes_of_any_length_go():
    said = "Nous votons (Texte adopté) à Lyon (Madrid) hier (article 3)."
    assert X.clean_all([said], "France") == [said]
    assert X.clean_all(["On parle (microcrédits) ici – (Vifs applaudissements) – encore [Rires]"], "France") == ["On parle (microcrédits) ici encore"]
    note = "Anhaltender Beifall " + "bei der SDB und " * 60
    assert X.clean_all([f"Das ist gut ({note}) und weiter", f"Ja [{note}] nein", "x" * 9], "Germany") == ["Das ist gut und weiter", "Ja nein", "X" + "x" * 8]
    assert X.clean_all(["(Beifall", "bei der SDB)", "– (Beifall) –", ""], "Germany") == ["(Beifall", "Bei der SDB)", "", ""]
    assert X.clean_all(["a \ufdd0 b", "c \ufdd1 d"], "Germany") == ["A b", "C d"]


def test_labels_of_any_length():
    name = "Anna " + "Maria Theresia von und zu Hohenlohe Langenburg Schillingsfürst " * 4 + "Berg"
    party = "Bund Aller Freien Wähler Der Mitte"
    for label in (f"{name}:", f"{name} ({party}):", f"{name} ({party}) –", f">> {name}:", f"[{name}]"):
        assert [(who, n) for _, who, n in show(f"C. Tal (Y): Ja.\n{label} Eins zwei.")] == [(1, 1), (2, 2)], label
    assert [(who, n) for _, who, n in show(f"C. Tal (Y): Ja.\n{name} ({party})\nEins zwei.")] == [(1, 1), (2, 2)]


def test_out_of_order_blocks_and_jitter():
    raw = "00:00:05 A. Berg (X): eins\n00:00:30 vier\n00:00:12 C. Tal (Y): zwei\n00:00:20 drei"
    assert show(raw) == [(1, 1, 1), (2, 2, 3)]
    assert [(t, at) for _, _, _, t, _, at in X.turns(raw, "Germany")] == [("Eins", 5.0), ("Zwei Drei Vier", 12.0)]


def test_isotonic_fit_has_the_least_absolute_error():
    rng = random.Random(4)
    for _ in range(200):
        values = [float(rng.randrange(6)) for _ in range(rng.randrange(1, 6))]
        fit = X.isotonic(values)
        error = lambda x, v=values: sum(abs(a - b) for a, b in zip(x, v, strict=True))
        best = min(error(x) for x in itertools.combinations_with_replacement([float(k) for k in range(6)], len(values)))
        assert fit == sorted(fit) and error(fit) == best
    assert X.isotonic([49.0, 67.0, 84.0, 99.0, 31.0]) == [49.0, 67.0, 84.0, 84.0, 84.0]


RESET = [f"00:00:{t:02d} {who}: {w}" for t, who, w in [(50, "A. Berg (X)", "eins"), (54, "C. Tal (Y)", "zwei"), (58, "A. Berg (X)", "drei"), (3, "C. Tal (Y)", "vier"), (8, "A. Berg (X)", "fünf"), (12, "C. Tal (Y)", "sechs")]]
JITTERED = ["00:00:05.00 A. Berg (X): eins", "00:00:10.40 C. Tal (Y): zwei", "00:00:10.10 A. Berg (X): drei", "00:00:30 C. Tal (Y): vier", "00:00:20 A. Berg (X): fünf"]


def test_the_fit_and_the_segments_decide_the_order(monkeypatch):
    texts = lambda raw: [t for _, _, _, t, _, _ in X.turns("\n".join(raw), "Germany")]
    assert texts(RESET) == ["Eins", "Zwei", "Drei", "Vier", "Fünf", "Sechs"]
    assert [at for *_, at in X.turns("\n".join(RESET), "Germany")] == [50.0, 54.0, 58.0, 61.0, 66.0, 70.0]
    # a small fall is jitter and keeps the stored order with the fitted time; a large one puts the block where its time says
    assert texts(JITTERED) == ["Eins", "Zwei", "Drei Fünf", "Vier"]
    assert [at for *_, at in X.turns("\n".join(JITTERED), "Germany")] == [5.0, 10.1, 10.1, 30.0]
    with monkeypatch.context() as m:
        m.setattr(X, "isotonic", list)
        assert texts(JITTERED) == ["Eins", "Zwei", "Drei", "Vier", "Fünf"]
    with monkeypatch.context() as m:
        m.setattr(X, "segments", lambda times: [0])
        assert texts(RESET) == ["Vier", "Fünf", "Sechs", "Eins", "Zwei", "Drei"]


def test_drifting_clocks_and_long_noisy_records():
    rng = random.Random(2)
    drift = [k * 0.3 + rng.random() * 0.4 for k in range(300)]
    assert [k for k, _ in X.repaired(drift)] == list(range(300))
    two = [*drift, *drift]
    assert X.segments(two) == [0, 300] and [k for k, _ in X.repaired(two)] == list(range(600))
    noise = [rng.random() * 3600 for _ in range(50_000)]
    began = time.perf_counter()
    found = X.repaired(noise)
    assert time.perf_counter() - began < 5
    assert sorted(k for k, _ in found) == list(range(50_000)) and [t for _, t in found] == sorted(t for _, t in found)


def test_clock_reset_keeps_the_stored_order():
    first = [X.Block(float(t), [str(t)]) for t in range(100, 1000, 100)]
    second = [X.Block(float(t), [f"b{t}"]) for t in range(5, 905, 100)]
    assert [b.lines[0] for b in X.ordered(first + second)] == [b.lines[0] for b in first + second]
    moved = [first[3], *first[:3], *first[4:]]
    assert X.ordered(moved) == first


def test_blocks_without_words_end_no_turn():
    raw = "A. Berg (X): Ja.\n(Beifall)\nC. Tal (Y): Hm... (Lachen)\nA. Berg (X): Nein."
    assert show(raw) == [(1, 1, 2)]


def test_srt_and_carriage_returns():
    raw = "1\r\n00:00:01,000 --> 00:00:02,000\r\nPRESIDENTE: Prego.\r\n\r\n2\r\n00:00:03,000 --> 00:00:04,000\r\nSi vota.\r\n"
    assert show(raw, "Italy") == [(1, 1, 3)]


def test_sentences_with_colons_are_no_labels():
    raw = "A. Berg (X): Eines ist klar: so nicht.\nWer Grünau kennt, weiß: es fehlt Geld."
    assert show(raw) == [(1, 1, 12)]


def test_first_speaker_and_degenerate_records():
    assert show(None) == show("") == show("\n \n") == show("(Beifall)") == []
    assert show("Ja.\nAnna Berg: Nein.", first="Anna Berg") == [(1, 1, 2)]
    assert show("Ja.\nAnna Berg: Nein.") == [(1, 1, 1), (2, 2, 1)]
    rng = random.Random(1)
    noise = "".join(rng.choices("[](){}<>*:,.–- \nAbä0123456789>t=", k=20_000))
    X.turns(noise, None, "x")
    assert X.turns("A. Berg (X): " + "wort " * 100_000, "Germany")[0][4] == 100_000


def test_table(spark):
    ddl = "speech_id string, country string, speaker_name string, raw_text string, delivered_at timestamp, text string, turn_no int"
    data = [("a", "DE", None, "A. Berg (X): Ja.", None, "x", 1), ("a", "DE", None, "A. Berg (X): Ja.", None, "x", 1), (None, "DE", None, "Ja.", None, None, 2), ("b", None, None, None, None, None, None), ("c", None, None, "Ja.", None, None, None)]
    got = sorted((r.speech_id, r.turn_no, r.speaker_no, r.n_words) for r in X.speaker_turns(spark.createDataFrame(data, ddl)).collect())
    assert got == [("a", 1, 1, 1), ("c", 1, 1, 1)]
    assert X.speaker_turns(spark.createDataFrame(data, ddl).limit(0)).count() == 0


def test_speeches_are_read_too(spark, tmp_path):
    from plenaria.llm.queries import QUERIES

    ddl = "speech_id string, country string, speaker_name string, speech_text string, raw_text string, delivered_at timestamp"
    data = [("a", "DE", "Anna Berg", "Ja. Nein.", "[00:00:02] Anna Berg: Ähm, ja. (Beifall)\n[00:00:05] C. Tal (Y): Nein.", None), ("b", "DE", None, "Ja.", None, None), ("c", "DE", "Anna Berg", "Gut so.", "Gut so.", None)]
    spark.createDataFrame(data, ddl).write.parquet(f"{tmp_path}/speeches.parquet")
    got = sorted((r.speech_id, r.turn_no, r.speaker_no, r.text, r.n_words) for r in QUERIES["p1_speech_turns"](spark, str(tmp_path)).collect())
    assert got == [("a", 1, 1, "Ja.", 1), ("a", 2, 2, "Nein.", 1), ("c", 1, 1, "Gut so.", 2)]
