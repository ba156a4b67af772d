"""Benchmark leaks that templates of plain openers and whole alignments lose."""

from __future__ import annotations

import pytest
from test_models import ITEM, leaks_of

from tillmark.llm import templates

TOM = "Tom has 5 apples. Tom gives 2 to Ann. How many are left with Tom now?"
SUM = "Compute the sum of 12, 15, 18, 21, 24 and 27 now."
DIGITS = "What is 12 + 7 - 3 * 5 + 18 - 4 + 9 + 31?"
TWICE = "The shop sells 12 pens to the first class in the morning and again 12 pens to the other class, so how many pens are sold by the shop before it closes?"


def test_names_that_open_sentences(spark):
    texts = [
        "Bob has 7 apples. Bob gives 3 to Sue. How many are left with Bob now?",
        "It says: Bob has 7 apples. Bob gives 3 to Sue. How many are left with Bob now? And on.",
        "Bob has 7 apples. Jim gives 3 to Sue. How many are left with Kim now?",  # one slot of the item, three values
        TOM,
    ]
    assert {d for d, _ in leaks_of(spark, texts, [TOM])} == {0, 1, 3}


def test_items_of_few_words(spark):
    short, verb = "Is 2 prime?", "Name the largest planet."
    texts = [f"Before. {SUM}", f"They wrote {DIGITS} and left.", SUM.replace("12", "13").replace("27", "30"), f"He said {short}", f"He said {verb}", "What is 12 + 7 - 3 * 5 + 18 - 4 + 9 + 32?", "Is 3 prime?", "Compute the sum of it all now."]
    assert leaks_of(spark, texts, [SUM, DIGITS, short, verb]) == {(0, 0), (1, 1), (2, 0), (3, 2), (4, 3)}


def test_coverage_counts_the_windows_there_are(spark):
    docs = spark.createDataFrame([(0, SUM)], "doc_id long, text string")
    row = templates.leaks(docs, spark.createDataFrame([(0, SUM)], "item_id long, text string")).first()
    assert row["coverage"] == pytest.approx(1.0) and row["windows"] == row["item_windows"]


def test_copies_with_one_value_or_the_case_changed(spark):
    changed = TWICE.replace("again 12", "again 13")
    assert leaks_of(spark, [changed, TWICE.lower(), TWICE.upper()], [TWICE]) == {(0, 0), (1, 0), (2, 0)}
    assert leaks_of(spark, [f"so {ITEM.upper()}", ITEM.lower(), " ".join(ITEM.split()[:11])], [ITEM]) == {(0, 0), (1, 0)}


def test_common_words_as_items_mark_nothing(spark):
    """Items of one or two tokens leak only as a whole line."""
    texts = ["Yes, he said. It is a fine day and yes again.", "Answer:\nYes\nend", "yes", "a b", "so 42 of\n42", "true north is\nTrue North\n", "is true north", "\n\nYES\n", "yes\nno"]
    assert leaks_of(spark, texts, ["Yes", "a", "42", "True north"]) == {(1, 0), (2, 0), (4, 2), (5, 3), (7, 0), (8, 0)}
