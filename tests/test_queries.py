"""Every query against its SQL over the smallest tables."""

from __future__ import annotations

import holding
import pytest

from termweave.queries import ALL, common, match, models


@pytest.mark.parametrize("name", [n for n, (_, sql) in ALL.items() if sql])
def test_query_agrees_with_sql(spark, duck, small, name):
    query, sql = ALL[name]
    df = query(spark, small)
    names, wanted = holding.of_sql(duck, sql)
    assert sorted(df.columns) == names
    found = holding.of(df)
    assert len(found) == len(wanted)
    assert found == wanted
    assert found, "a query of no rows shows nothing"


@pytest.mark.parametrize("name, whole", (("wide_view", 1), ("stage4_replace", 1), ("synonym_boost", 1), ("rrf_fusion", 2)))
def test_no_search_is_made_for_nothing(spark, small, monkeypatch, name, whole):
    made, search, n = [], match.topk.vector_topk, spark.read.parquet(f"{small}/embeddings.parquet").count()
    monkeypatch.setattr(match.topk, "vector_topk", lambda q, *more, **named: made.append(q.count()) or search(q, *more, **named))
    ALL[name][0](spark, small).count()
    assert made.count(n) == whole and len(made) <= 2


def test_list_rerank_orders_each_text_once(spark, small, monkeypatch):
    texts = [r["text"] for r in common.queries(spark, small).collect()]
    made, search = [], models.topk.gram_topk
    monkeypatch.setattr(models.topk, "gram_topk", lambda q, *more: made.append(q.count()) or search(q, *more))
    found = ALL["list_rerank"][0](spark, small)
    assert made == [len(set(texts))] and made[0] < len(texts)
    assert found.select("qid").distinct().count() == len(texts)


def test_schema_cascade(spark, small):
    found = {(r["col"], r["rank"]): r for r in ALL["schema_cascade"][0](spark, small).collect()}
    first = {c: (r["stage"], r["method"], r["field"], r["score"]) for (c, rank), r in found.items() if rank == 1}
    assert first["event_type"] == ("stage1", "std_exact", "event_type", 1.0)
    assert first["p_retailprice"] == ("stage1", "alias_exact", "retail_price", 1.0)
    assert first["o_orderstatus"][0] in ("stage1", "stage2") and first["c_mktsegment"][2] in ("market_segment", "segment")
    assert {c: first[c][2] for c in ("o_orderdate", "l_shipdate", "c_acctbal", "s_acctbal", "l_returnflag")} == {"o_orderdate": "order_date", "l_shipdate": "ship_date", "c_acctbal": "account_balance", "s_acctbal": "account_balance", "l_returnflag": "return_flag"}
    assert {m for _, m, _, _ in first.values()} >= {"std_exact", "alias_exact", "value", "ontology", "numeric", "semantic"}
    assert first["p_type"][2] == "material"
    assert all(0 <= r["score"] <= 1.4 for r in found.values())


def test_suggested_fields(spark, small):
    found = ALL["suggested_fields"][0](spark, small).collect()
    columns = [c for r in found for c in r["source_columns"]]
    assert found and len(columns) == len(set(columns))
    assert all(len(r["source_columns"]) >= 2 and 0 <= r["confidence"] <= 1 for r in found)
    assert [r["confidence"] for r in found] == sorted((r["confidence"] for r in found), reverse=True)
