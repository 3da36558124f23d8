"""Rows without doc_id, repeated doc_ids and very short items in the filtering stages."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from careflow.llm import decontaminate, shingle_join

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
TEXT, OTHER = " ".join(WORDS), " ".join(reversed(WORDS))


def rows(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def docs(spark, given):
    return spark.createDataFrame([(d, t, "x") for d, t in given], "doc_id long, text string, lang string").repartition(3)


def test_one_row_of_each_group_stays(spark):
    near = " ".join(WORDS + ["more"])
    given = [(7, TEXT), (7, TEXT), (None, TEXT), (None, near), (9, near), (None, OTHER), (None, OTHER), (3, None), (3, ""), (None, None)]
    kept = rows(shingle_join.representatives(docs(spark, given)))
    assert kept == Counter([(7, TEXT), (None, OTHER), (3, None), (3, ""), (None, None)])


def test_repeated_id_with_different_texts(spark):
    kept = rows(shingle_join.representatives(docs(spark, [(1, TEXT), (1, OTHER), (2, TEXT), (0, OTHER)])))
    assert kept == Counter([(1, TEXT), (0, OTHER)])


def test_plain_ids_keep_the_smallest(spark):
    near = " ".join(WORDS + ["more"])
    kept = rows(shingle_join.representatives(docs(spark, [(5, TEXT), (4, near), (6, OTHER), (8, None)])))
    assert kept == Counter([(4, near), (6, OTHER), (8, None)])


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "short Test item"), (2, "one"), (3, TEXT), (4, None), (5, " "), (3, TEXT)], "item_id long, text string")


def test_short_items_are_found_in_long_texts(spark, benchmark):
    given = [(1, "here is a short test item in a long text about other things"), (2, "short test"), (3, "a short test, item"), (4, "SHORT\ttest  item"),
             (5, "not one but two"), (6, "x " + TEXT + " y"), (7, "test item short test"), (8, None), (None, "a short test item")]
    found = decontaminate.contained_items(docs(spark, given), benchmark).collect()
    assert {(r.doc_id, r.item_id, r.containment) for r in found} == {(1, 1, 1.0), (4, 1, 1.0), (5, 2, 1.0), (6, 3, 1.0)}


def test_rows_without_id_go_by_their_text(spark, benchmark):
    given = [(None, "x " + TEXT + " y"), (None, "clean text"), (None, "clean text"), (None, None), (1, TEXT), (2, "clean"), (2, "has one inside")]
    kept = rows(decontaminate.decontaminate(docs(spark, given), benchmark))
    assert kept == Counter({(None, "clean text"): 2, (None, None): 1})
    assert decontaminate.decontaminate(docs(spark, given).filter(F.lit(False)), benchmark).count() == 0


@pytest.mark.parametrize("kind", ["float", "double"])
def test_vectors_under_one_id(spark, kind):
    from careflow.llm import hnsw_dedup

    near, other = [1.0, 0.1, 0.0], [0.0, 0.0, 1.0]
    given = [(5, [1.0, 0.0, 0.0]), (5, near), (9, near), (5, other), (2, other), (7, [0.5, -0.5, 0.0])]
    got = hnsw_dedup.linked(spark.createDataFrame(given, f"vec_id long, embedding array<{kind}>")).collect()
    assert Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == Counter(
        [(5, 2, 5, True), (5, 2, 5, True), (9, 2, 5, False), (5, 1, 2, False), (2, 1, 2, True), (7, 0, 7, True)])


def test_large_doubles(spark):
    from careflow.llm import hnsw_dedup

    given = [(1, [1e200, 1.0]), (2, [1e200, 1.0]), (3, [1.0, 1e200]), (4, [float("inf"), 1.0])]
    got = hnsw_dedup.linked(spark.createDataFrame(given, "vec_id long, embedding array<double>")).collect()
    assert {(r.vec_id, r.n_links, r.component_id) for r in got} == {(1, 1, 1), (2, 1, 1), (3, 0, 3), (4, 0, 4)}
