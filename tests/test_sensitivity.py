from __future__ import annotations

import pytest

from colaudit.operators import sensitivity
from colaudit.schemas import COLUMNS

FIELDS = [f.split()[0].strip("`") for f in COLUMNS.split(", ")]


def column(name, samples=(), kind="string", pk=False, fk=False, temporal=False, table="t"):
    row = dict.fromkeys(FIELDS)
    row |= dict(qualified_name=f"{table}.{name}", table=table, name=name, generic_type=kind, raw_type=kind, nullable=True, is_primary_key=pk, is_foreign_key=fk, is_unique=False, is_indexed=False, is_temporal=temporal, sample_values=list(samples))  # noqa: C408
    return tuple(row[f] for f in FIELDS)


@pytest.fixture
def classify(spark):
    def run(*rows, **kw):
        return {r["name"]: r for r in sensitivity.classify(spark.createDataFrame(list(rows), COLUMNS), **kw).collect()}

    return run


def test_names(classify):
    r = classify(column("ssn"), column("email_address"), column("favorite_color"), column("password_hash"), column("first_name"), column("mothers_maiden_name"), column("ip_address"), column("quux"))
    assert (r["ssn"]["score"], r["ssn"]["pii_type"], r["ssn"]["tier"]) == (0.95, "government_id", "high")
    assert r["email_address"]["pii_type"] == "contact" and r["email_address"]["is_sensitive"]
    assert r["favorite_color"]["score"] == 0.0 and not r["favorite_color"]["is_sensitive"]
    assert r["password_hash"]["pii_type"] == "credential"
    assert r["mothers_maiden_name"]["pii_type"] == "knowledge_based"
    assert r["ip_address"]["pii_type"] == "network_id"  # not an address
    assert r["quux"]["score"] == 0.0 and r["quux"]["pii_type"] is None


def test_values_decide_without_a_name(classify):
    r = classify(
        column("a", ["123-45-6789", "987-65-4321", "x"]), column("b", ["a@b.co", "c@d.org"]), column("c", ["10.0.0.1", "10.0.0.2"]), column("d", ["4111111111111111"]), column("e", ["2001-02-03"]),
        column("f", ["call +1 (555) 123-4567 now", "nothing", "nothing"]), column("g", ["write to a@b.co"]), column("h", ["12345678-1234-1234-1234-123456789012"]),
    )
    assert [r[k]["score"] for k in "abcdefgh"] == [0.92, 0.85, 0.7, 0.8, 0.35, 0.35, 0.5, 0.08]
    assert "value:ssn_like" in r["a"]["matched_rules"] and r["h"]["pii_type"] is None


def test_agreement_adds(classify):
    r = classify(column("email", ["a@b.co"]))["email"]
    assert (r["score"], r["confidence"]) == (0.95, 0.95)


def test_structure(classify):
    r = classify(column("id", pk=True), column("user_id", fk=True), column("created_at", temporal=True, kind="timestamptz"), column("ssn", pk=True), column("order_status"), column("last_ip_flag", kind="inet"), column("billing_city"))
    assert (r["id"]["score"], r["id"]["pii_type"]) == (0.0, None)
    assert (r["user_id"]["score"], r["user_id"]["pii_type"]) == (0.1, "linkage")
    assert r["created_at"]["score"] <= 0.03
    assert r["ssn"]["score"] == 0.95  # a strong name outweighs the key
    assert r["order_status"]["score"] <= 0.08
    assert "type:inet" in r["last_ip_flag"]["matched_rules"]


def test_threshold_is_inclusive(classify):
    assert classify(column("body"))["body"]["is_sensitive"]
    assert not classify(column("body"), threshold=0.51)["body"]["is_sensitive"]


def test_nulls_and_empty(classify, spark):
    assert classify(column("x", [None, None]))["x"]["score"] == 0.0
    assert sensitivity.classify(spark.createDataFrame([], COLUMNS)).count() == 0
