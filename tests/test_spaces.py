"""Spaces of placeholders that large tables fill."""

import pytest
from pyspark.sql import functions as F

from cloakframe.functions import entities, formats
from cloakframe.operators.vault import Vault
from cloakframe.plans.queries import QUERIES
from cloakframe.plans.redactor import Redactor


@pytest.mark.parametrize("name, key, text", [("documents", "doc_id", "text"), ("pages", "page_id", "html")])
def test_whole_tables_of_many_networks(spark, tmp_path, name, key, text):
    """More networks than 198.18.0.0/15 has placeholders come back."""
    rows = spark.range(600).select(F.col("id").alias(key), F.expr("concat('up 10.', id div 200, '.', id % 200, '.7')").alias(text))
    rows.write.parquet(f"{tmp_path}/{name}.parquet")
    assert sorted(map(tuple, QUERIES[f"roundtrip_{name}"](spark, str(tmp_path)).collect())) == sorted(map(tuple, rows.collect()))


def test_networks_that_look_like_placeholders(spark, tmp_path):
    """A made-up address that stands in a text is no network's placeholder, so it is itself when all come back."""
    made = ["198.18.7.1", "198.19.255.2", "240.0.3.4", "240.0.5.6", "240.9.9.9", "198.18.300.1"]
    rows = spark.range(600).select(F.col("id").alias("doc_id"), F.expr("concat('up 10.', id div 200, '.', id % 200, '.7')").alias("text"))
    rows = rows.union(spark.createDataFrame([(1000 + k, f"at {x}") for k, x in enumerate(made)], "doc_id long, text string")).coalesce(2)
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, QUERIES["roundtrip_documents"](spark, str(tmp_path)).collect())) == sorted(map(tuple, rows.collect()))
    vault = Vault(spark, f"file://{tmp_path}/vault", extended=True)
    redactor = Redactor(spark, vault)
    first = redactor.tokenize(rows.where("doc_id < 100 or doc_id >= 1000"), "doc_id", "text").rows.cache()
    second = redactor.tokenize(rows.where("doc_id < 600"), "doc_id", "text").rows.cache()
    for done in (first, second):
        assert redactor.detokenize(done, "text").exceptAll(rows).count() == 0
    slots = [r.seq for r in vault.entries().collect()]
    assert sorted(slots) == [n for n in range(604) if n not in (7, 511, 515, 517)] and second.count() == 600


def test_networks_of_six_that_look_like_placeholders(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"at 2600:a{k:03x}::1") for k in range(5)] + [(9, "at fd00:c0de:0:2::1 and fd00:c0de::7")], "id long, text string")
    redactor = Redactor(spark, Vault(spark, f"file://{tmp_path}"))
    done = redactor.tokenize(rows, "id", "text").rows.cache()
    assert redactor.detokenize(done, "text").exceptAll(rows).count() == 0
    assert sorted(r.seq for r in redactor.vault.entries().collect()) == [1, 3, 4, 5, 6]


def test_more_numbers_abroad_than_short_placeholders(spark, tmp_path):
    """10,000 numbers don't fit into 9,900 short placeholders beside what stands in the texts: the rest get longer ones."""
    rows = spark.range(10_000).select("id", F.expr("concat('+44 20 7946 ', lpad(id, 4, '0'), ' or +1-555-12', lpad(id % 100, 2, '0'), ' or +1-555-1234567890')").alias("text"))
    redactor = Redactor(spark, Vault(spark, f"file://{tmp_path}"))
    done = redactor.tokenize(rows, "id", "text")
    want = rows.withColumn("text", F.regexp_replace("text", r"\+44 20 7946 ", "+44207946"))
    hidden = done.rows.cache()
    assert hidden.where("text like '%20 7946%'").count() == 0 and hidden.where(r"text rlike '^\\+44-555-[0-9]{10} '").count() > 100
    assert redactor.detokenize(hidden, "text").exceptAll(want).count() == 0 == done.rejects.count()
    assert redactor.tokenize(hidden, "id", "text").rows.exceptAll(hidden).count() == 0


def test_digits_behind_a_short_placeholder():
    real = {"555-1234": "+44207946000", "555-1234567890": "+44207946111"}
    assert formats.restore("+44-555-1234567890 +44-555-12345678 +44-555-1234 +44-555-1234999999", real) == "+44207946111 +442079460005678 +44207946000 +44207946000999999"
    assert entities.placeholder("intl_phone", "x", attempt=entities.WIDE_FROM) in formats.candidates(f"+44-{entities.placeholder('intl_phone', 'x', attempt=entities.WIDE_FROM)}")


def test_known_values_beside_other_detectors(spark, tmp_path):
    """Key 1613's secret holds twelve digits with a valid check digit; its text stays, as the query's SQL says."""
    spark.createDataFrame([(1613,), (1614,)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    got = {r.c_custkey: r.text for r in QUERIES["known_values"](spark, str(tmp_path)).collect()}
    assert got[1613] == "so xpw-963826088133" and got[1614].startswith("so FAKE-PASSWORD-")
