"""Dense, long and repeated inputs: whole results in time that grows with the input."""

import random
import time

import pytest

from tidemark.llm.decontaminate import decontaminate
from tidemark.llm.license_scan import license_scan
from tidemark.llm.secret_scan import secret_scan
from tidemark.llm.suffix_dedup import remove_repeats

TEXTS = "doc_id long, text string"


def test_hidden_detections_hide_nothing(spark):
    """A overlaps B, B overlaps C: B goes, so C stays. A longer one takes the place of those inside it."""
    book = [(0, "a", "aa", 0, "aa bb cc", 0.5, False), (1, "b", "cc", 0, "cc dd ee", 0.5, False), (2, "c", "ee", 0, "ee ff gg", 0.5, False), (3, "long", "xx", 0, "xx yy zz", 0.9, False), (0, "short", "yy", 0, "yy", 0.4, False)]
    docs = spark.createDataFrame([(1, "aa bb cc dd ee ff gg"), (2, "cc dd ee ff gg"), (3, "xx yy zz yy"), (4, "yy")], TEXTS)
    got = {r.doc_id: (r.labels, r.n_found) for r in license_scan(docs, signature_rules=book).collect()}
    assert got == {1: ("a,c", 2), 2: ("b", 1), 3: ("long,short", 2), 4: ("short", 1)}


def test_dense_licenses(spark):
    r = license_scan(spark.createDataFrame([(1, "mit license " * 40_000)], TEXTS)).first()
    assert (r.n_base, r.last_word, r.labels, r.n_found) == (40_000, 79_998, "mit", 40_000)


def test_dense_secrets(spark):
    """A megabyte of starts of one format, and 16,000 hits in one text."""
    begun = time.time()
    data = [(1, "eyJ" * 350_000, "a"), (2, " ".join(f"token=abcdef{i:06d}" for i in range(16_000)), "b")]
    got = {r.doc_id: r for r in secret_scan(spark.createDataFrame(data, f"{TEXTS}, source string")).collect()}
    assert got[1].spans == "" and got[2].n_assign == 16_000
    assert got[2].spans.split(",")[-1] == f"assign:{15_999 * 19}:{15_999 * 19 + 18}" and time.time() - begun < 60


@pytest.mark.parametrize("rows", [300, 600])
def test_repeated_rows(spark, rows):
    """Rows that repeat identifier and text: all bytes go, of null identifiers too, and the time does not grow with the square."""
    rng = random.Random(1)
    text = "".join(rng.choice("abcdefghij ") for _ in range(3000))
    got = remove_repeats(spark.createDataFrame([(1, text)] * rows + [(None, text[:1500])] * rows + [(2, text[:150])], TEXTS)).collect()
    assert len(got) == 2 * rows + 1 and all(r.n_removed == (0 if r.doc_id == 2 else r.n_bytes) for r in got)


def test_a_table_of_numbers(spark):
    """A long table against an item of numbers: windows of one kind, and a document without numbers stays."""
    rng = random.Random(1)
    docs = [(1, " ".join(str(rng.randint(0, 10**6)) for _ in range(40_000))), (2, "plain words only here and there")]
    items = [(7, " ".join(str(rng.randint(0, 10**6)) for _ in range(100)))]
    got = {r.doc_id: r.item_ids for r in decontaminate(spark.createDataFrame(docs, TEXTS), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {1: "7", 2: ""}
