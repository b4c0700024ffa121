"""Texts and pages on which a method could stall, run out of memory or lose text."""

import random
import time

import pytest

from tradeloom.llm import html_render, toxicity


@pytest.mark.parametrize("page, text", [("a<!-->b", "ab"), ("a<!--->b", "ab"), ("a<!-- x --!>b", "ab"), ("a<!-- x -->b", "ab"), ("a<!----!>b", "ab"), ("a<!-- x", "a"), ("a<!-- > -- x -->b", "ab")])
def test_comments_end_where_the_standard_says(page, text):
    assert html_render.render(page) == text


@pytest.mark.parametrize("page", [
    "<table><tr>" + "".join("<td>" + "x" * 80 for _ in range(1800)) + ("<tr>" + "<td colspan=1000>y" * 3 + "<td>z") * 1800 + "</table>",
    "<table><tr>" + "<td colspan=1000 rowspan=1000>a" * 2000 + "<tr><td>b" * 2000 + "</table>",
    "<table><tr>" + "".join(f"<td colspan=1000 rowspan={2 + i % 9}>a" for i in range(2000)) + "<tr><td>b" * 2000 + "</table>",
])
def test_wide_tables_stay_near_the_size_of_their_text(page):
    began = time.process_time()
    text = html_render.render(page)
    assert time.process_time() - began < 10
    assert len(text) < 5_000_000 and len(text) < 8 * len(page)
    for letter in "abxyz":
        assert text.count(letter) == page.split("<table>")[1].replace("<table", "").replace("table>", "").count(f">{letter}") * (80 if letter == "x" else 1)


def test_rows_are_aligned_as_before():
    page = "<table><tr><th>name<th>n<th>note</tr><tr><td rowspan=2>ab<td>1<td>x y</tr><tr><td>22<td>z</tr><tr><td colspan=2>wide cell<td>end</tr></table>"
    assert html_render.render(page).split("\n") == ["name  n   note", "ab    1   x y", "      22  z", "wide cell end"]


def plain_hits(lexicon, text):
    """The heaviest pattern of each word that lies in no exception phrase, by looking everywhere."""
    t = toxicity.fold(text)
    spans = lambda p: [(i, i + len(p)) for i in range(len(t)) if t.startswith(p, i)]
    safe = [s for e in lexicon.exceptions for s in spans(toxicity.fold(e))]
    best = {}
    for p, w in lexicon.weights.items():
        for s, e in spans(p):
            if not any(a <= s and e <= b for a, b in safe):
                start = t.rfind(" ", 0, e - 1 if t[e - 1] == " " else e)
                best[start] = max(best.get(start, 0), w)
    return sum(best.values())


def test_exceptions_are_those_of_a_plain_search():
    rng = random.Random(9)
    lexicon = toxicity.Lexicon({" trash ": 3.0, " tras": 1.0, "bage ": 2.0, " can ": 0.5}, exceptions=["trash can", "white trash can", "can trash", "garbage"])
    for _ in range(400):
        text = " ".join(rng.choices(["trash", "can", "white", "garbage", "x", "trashy", "cabbage"], k=rng.randint(0, 14)))
        assert abs(lexicon.sums([text])[0][0] - plain_hits(lexicon, text)) < 1e-9


def test_long_texts_with_exception_phrases_take_time_in_proportion():
    lexicon = toxicity.Lexicon({" trash ": 3.0, " can ": 1.0}, exceptions=["trash can"])
    began = time.process_time()
    hit, words = lexicon.sums(["trash can " * 100_000])
    assert time.process_time() - began < 2 and hit[0] == 0 and words[0] == 200_000


def test_languages_of_tables_with_columns_of_the_names_used_inside(spark):
    from tradeloom.llm import language_id

    rows = [(k, ("the cat and the dog " if k % 2 else "der hund und die katze ") * 5, "en" if k % 2 else "de", "a", 1, "b", 0.5) for k in range(60)] + [(None, "the", None, None, None, None, None), (61, None, "en", None, 2, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, id string, rank int, body string, score double")
    got = {r.doc_id: r.lang_pred for r in language_id.predict(docs, language_id.learn(docs)).collect()}
    assert len(got) == 62 and got[61] == "und" and {got[k] for k in range(1, 60, 2)} == {"en"} and {got[k] for k in range(0, 60, 2)} == {"de"}
    few = language_id.learn(docs, sample=4, sample_docs=8, sample_words=5)
    assert language_id.predict(docs, few).where("lang_pred is null").count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_targets_of_many_sources_are_those_of_repeated_sharing(spark, seed):
    """The running sum finds the level that sharing again and again settles at."""
    from tradeloom.llm import mixing

    rng = random.Random(seed)
    sizes = [rng.choice([0, 1, 2, 5, 40, 1000, 10**7]) if seed else 0 for _ in range(60)]
    units = spark.createDataFrame([(f"s{k:03d}" if k else None, n, 1) for k, n in enumerate(sizes)], "source string, size long, rows long")
    got = {r.source: r.target for r in mixing.source_targets(units).collect()}
    order = [*range(1, 60), 0]
    weight = {k: (1, 2, 3)[i % 3] for i, k in enumerate(order)}
    level, full = 0.0, -1
    while True:
        stops = [k for k in order if sizes[k] * 3 < weight[k] * level]
        if len(stops) == full:
            break
        full, level = len(stops), (sum(sizes) - sum(3 * sizes[k] for k in stops)) / sum(weight[k] for k in order if k not in stops)
    assert got == {f"s{k:03d}" if k else None: min(weight[k] * level, 3.0 * sizes[k]) for k in order}
    assert mixing.source_targets(units.where("false")).count() == 0
