"""Text functions on small cases."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from termweave.functions import similarity as sim
from termweave.functions import text as tx


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("text", "wanted"), [("tumor-size!", "tumor size"), ("a--b__c", "a b c"), ("  X ", "x"), ("é1", "1"), ("", "")])
def test_normalize(spark, text, wanted):
    assert one(spark, tx.normalize(F.lit(text))) == wanted


@pytest.mark.parametrize(("text", "wanted"), [("a<;>b<;>c", ["a", "b", "c"]), ("na;Na;NA;valid", ["valid"]), ("x::y; z", ["x", "y", "z"]), ("", [])])
def test_valid_values(spark, text, wanted):
    assert one(spark, tx.valid_values(F.lit(text))) == wanted


@pytest.mark.parametrize(("text", "wanted"), [("breast_cancer", "breast cancer"), ("Leukaemia", "leukemia"), ("tumour", "tumor")])
def test_american(spark, text, wanted):
    assert one(spark, tx.american(F.lit(text))) == wanted


@pytest.mark.parametrize(("code", "clean", "onto"), [("NCIT:C1", "C1", "ncit"), ("UBERON:0001", "UBERON_0001", "uberon"), ("COB:1", "COB_1", None), ("C12", "C12", "ncit")])
def test_codes(spark, code, clean, onto):
    c = tx.clean_code(F.lit(code))
    assert one(spark, c) == clean
    assert one(spark, tx.ontology(c)) == onto


@pytest.mark.parametrize(("header", "family"), [("dose mg", "dose"), ("age at diagnosis", "age"), ("start date", "time"), ("colour", "unknown")])
def test_numeric_family(spark, header, family):
    h = F.lit(header)
    assert one(spark, tx.numeric_family(tx.without_units(h), tx.unit_tags(h))) == family


@pytest.mark.parametrize(("field", "column", "boost"), [("treatment_dose", "tx_response", 0.2), ("patient_age", "tx_response", 0.0), ("treatment_type", "hormone_therapy", 0.2)])
def test_treatment_boost(spark, field, column, boost):
    assert one(spark, tx.treatment_boost(F.lit(field), F.lit(column))) == pytest.approx(boost)


@pytest.mark.parametrize(("value", "number"), [("1", True), (" -2.5e3 ", True), (".5", True), ("1a", False), ("", False)])
def test_is_number(spark, value, number):
    assert one(spark, tx.is_number(F.lit(value))) is number


@pytest.mark.parametrize(("allowed", "pattern"), [("^x$", True), ("a|b", False), ("[0-9]+", True), ("a{2}", True), ("vegan|omnivore", False)])
def test_is_pattern(spark, allowed, pattern):
    assert one(spark, tx.is_pattern(F.lit(allowed))) is pattern


def test_enriched_stops_at_the_cap(spark):
    context = F.array(F.struct(F.lit("BODY_SITE").alias("name"), F.lit("THYMUS").alias("value")), F.struct(F.lit("NOTES").alias("name"), F.lit("nan").alias("value")))
    assert one(spark, tx.enriched(F.lit("TC:SCC"), context)) == "TC:SCC; Body Site: THYMUS"
    assert one(spark, tx.enriched(F.lit("TC:SCC"), context, 10)) == "TC:SCC"


def lcs(a: str, b: str) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


@pytest.mark.parametrize(("a", "b"), [("abc", "abd"), ("kitten", "sitting"), ("x", "x"), ("a" * 70, "b" * 3 + "a" * 66), ("tumour size", "size tumor")])
def test_indel_ratio(spark, a, b):
    x, y = F.col("a"), F.col("b")
    got = one(spark, sim.indel_ratio(sim.lcs(x, y, sim.letter_masks(y)), x, y), a=a, b=b)
    assert got == pytest.approx(200 * lcs(a, b) / (len(a) + len(b)))


@pytest.mark.parametrize(("needle", "text"), [("sample count", "total_sample_counts"), ("sample count", "sample"), ("abc", "xxabcxx")])
def test_partial_ratio(spark, needle, text):
    windows = [text[max(0, i) : i + len(needle)] for i in range(1 - len(needle), len(text))] if len(text) >= len(needle) else [text]
    wanted = max(200 * lcs(w, needle) / (len(w) + len(needle)) for w in windows if w)
    assert one(spark, sim.partial_ratio(needle, F.col("t")), t=text) == pytest.approx(wanted)


def test_jaccard_and_overlap_of_nothing(spark):
    none, some = F.array().cast("array<string>"), F.array(F.lit("a"))
    assert one(spark, sim.jaccard(none, none)) == 1.0
    assert one(spark, sim.jaccard(none, some)) == 0.0
    assert one(spark, sim.overlap(none, some)) == 0.0
