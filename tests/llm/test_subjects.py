from __future__ import annotations

import random

import numpy as np
import pytest

from tidewell.llm import subjects as S
from tidewell.llm.garbled import repair, words

TEXTS = ["Über die Größe – „schön“ wäre das.", "L’été, à l’hôpital, coûte 20 €.", "¿Qué pasó con el niño?", "Проверка кодировки: сервер и база данных."]


def _read(text: str, written: str, read: str) -> str:
    raw = text.encode(written)
    return "".join(bytes([b]).decode(read) if _defined(b, read) else chr(b) for b in raw)


def _defined(b: int, charset: str) -> bool:
    try:
        bytes([b]).decode(charset)
    except UnicodeDecodeError:
        return False
    return True


@pytest.mark.parametrize("text", TEXTS)
@pytest.mark.parametrize("read", ["cp1252", "latin-1", "cp1251"])
def test_utf8_read_as_something_else_is_repaired(text, read):
    assert words(repair(_read(text, "utf-8", read))) == words(text)


@pytest.mark.parametrize("written", ["cp1251", "koi8-r"])
def test_cyrillic_read_as_western_is_repaired(written):
    text = TEXTS[3] * 3
    assert words(repair(_read(text, written, "latin-1"))) == words(text)


def test_what_is_fine_stays_and_lost_letters_dont_matter():
    for t in [*TEXTS, "", "plain ascii", "a" * 300_000, "\x00\ud800"]:
        assert words(repair(t)) == words(t)
    assert words("m��decin") == words("médecin") == words("médecin") == ["mdecin"]
    assert S.own_text(None) == S.own_text("") == []


def test_words_of_any_script():
    assert words("Η δίκη άρχισε") == ["δίκη", "άρχισε"] and words("法院判决") == ["法院", "院判", "判决"] and words("कानून 12 ab") == ["कानून"]


LAW, SPORT, COOK = ["tribunal", "verdict", "bail", "judge", "injunction"], ["goalkeeper", "striker", "referee", "offside", "sprint"], ["saucepan", "butter", "dough", "whisk", "oven"]
AREAS = ["cooking", "law", "sport"]


def _page(*areas, n=8):
    pools = {"law": LAW, "sport": SPORT, "cooking": COOK}
    menu = "Home Law Sport Recipes Contact accept cookies privacy"
    return menu + ". " + " ".join(f"after the {random.choice(pools[a])} came the old house" for a in areas for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    random.seed(6)
    rows, labels, truth = [], [], {}
    for k in range(300):
        areas = [("law",), ("sport",), ("cooking",), ("law", "sport"), ()][k % 5]
        rows.append((k, _page(*areas), "x"))
        truth[k] = set(areas)
        if k % 2 == 0 and len(areas) < 2:
            labels += [(k, (areas[0] if areas else "none").upper(), "r")] * 2
    rows += [(900, None, "x"), (901, "", "x"), (902, "goalkeeper " * 30_000, "x")]
    truth |= {900: set(), 901: set(), 902: {"sport"}}
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, words string")
    lab = spark.createDataFrame([*labels, (None, "law", "r"), (5, None, "r"), (7, "nonsense", "r")], "doc_id bigint, area string, labeller string")
    return docs, lab, truth


def _right(found, truth):
    got: dict[int, set] = {}
    for r in found.collect():
        got.setdefault(r.doc_id, set()).add(r.area)
    assert 900 not in got and 901 not in got
    return sum(got.get(k, set()) == v for k, v in truth.items()) / len(truth), got


def test_areas_of_a_small_corpus(corpus):
    docs, labels, truth = corpus
    share, got = _right(S.subject_areas(docs, labels, AREAS), truth)
    assert share >= 0.95 and got[902] == {"sport"}


@pytest.mark.parametrize("kind", ["random", "exchanged"])
def test_the_topics_decide(corpus, monkeypatch, kind):
    docs, labels, truth = corpus
    fit = S.fit_topics

    def other(tokens, lexicon, *rest):
        fitted = fit(tokens, lexicon, *rest)
        vocabulary, rng = lexicon["word"].tolist(), np.random.default_rng(1)
        made = fitted.copy()
        made[vocabulary] = rng.dirichlet(np.full(len(vocabulary), 5.0), len(fitted)) if kind == "random" else fitted[vocabulary].to_numpy()[:, rng.permutation(len(vocabulary))]
        return made

    monkeypatch.setattr(S, "fit_topics", other)
    assert _right(S.subject_areas(docs, labels, AREAS), truth)[0] <= 0.6


def test_rare_words_have_a_place_and_order_of_rows_doesnt_matter(corpus):
    docs, labels, truth = corpus
    first = _right(S.subject_areas(docs, labels, AREAS), truth)[1]
    assert first == _right(S.subject_areas(docs.orderBy("text").repartition(3), labels.repartition(2), AREAS), truth)[1]


def test_announcements_are_learned_from_what_follows_them(spark):
    random.seed(2)
    pools = {"law": LAW, "sport": SPORT, "cooking": COOK}
    rows = []
    for k in range(60):
        own = AREAS[k % 3]
        other = AREAS[(k + 1 + k % 2) % 3]
        rows.append((k, [own], f"{_page(own)}.\nMore to say: {random.choice(pools[own])}.\nWeiter dazu auch : {random.choice(pools[other])} / {random.choice(pools[other])}\nend"))
    sample = spark.createDataFrame(rows, "doc_id bigint, areas array<string>, _text string")
    lexicon = S.content_words(S._tokens(sample, "doc_id", None), AREAS)
    heads = S.teaser_heads(sample, lexicon, AREAS)
    assert "dazu auch" in heads and not any("say" in h for h in heads)
    assert not set(S.own_text("bail\nweiter dazu auch: whisk / oven\njudge", S.teaser_pattern(heads))) & {"whisk", "oven"}


def test_no_documents_and_no_labels(corpus):
    docs, labels, _ = corpus
    assert S.subject_areas(docs.limit(0), labels, AREAS).count() == 0
    assert S.subject_areas(docs, labels.limit(0), AREAS).count() == 0


def test_only_the_teaser_is_cut():
    teaser = S.teaser_pattern(["read next", "sie auch", "lire aussi", "lea tambi¤n"])
    line = "Read next: Trial / memory leak Home · Contact Notes 4 the goalkeeper stood there. © 5 x.example"
    assert S.own_text(line, teaser) == ["home", "contact", "notes", "the", "goalkeeper", "stood", "there", "example"]
    assert S.own_text("bail\nSie auch: Kurs / Offener Port\njudge", teaser) == ["bail", "judge"]
    assert S.own_text("bail. À lire aussi : Rupture de contrat / juge © 71 host", teaser) == ["bail", "host"]
    assert S.own_text("bail\nLea tambiГ©n: juez\njudge", teaser) == ["bail", "judge"] and S.teaser_pattern([]) is None
