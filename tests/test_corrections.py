import json

import pytest

from folio import session
from folio.operators import corrections


def answers(spark, body):
    blocks = spark.createDataFrame([(1, "b1", 0, "p", "one"), (1, "b2", 1, "p", "two")], "page_id bigint, block_id string, ord bigint, type string, text string")
    response = json.dumps({"choices": [{"message": {"content": json.dumps(body)}}]})
    got = corrections.results(spark.createDataFrame([(1, response)], "page_id bigint, response string"), blocks)
    return [(r.block_id, r.text) for r in got.orderBy("ord").collect()]


def test_a_null_text_removes_the_block(spark):
    assert answers(spark, {"changes": [{"id": "b1", "text": None}]}) == [("b2", "two")]
    assert answers(spark, {"changes": [{"id": "b1", "text": "new"}]}) == [("b1", "new"), ("b2", "two")]


def test_pages_of_unreadable_agents_are_reported(spark):
    payloads = spark.createDataFrame([(1, 1, "x"), (2, 9, "y"), (3, 1, None)], "page_id bigint, agent bigint, payload string")
    settings = spark.createDataFrame([("a", "m", 0.1, 0.2, "low", 5)], "name string, model string, temperature double, top_p double, reasoning_effort string, max_output_tokens bigint")
    prompts = spark.createDataFrame([(1, "a", "fix")], "agent bigint, name string, prompt string")
    got = {r.page_id: r for r in corrections.requests(payloads, settings, prompts).collect()}
    assert json.loads(got[1].request)["instructions"] == "fix" and got[1].error is None
    assert (got[2].request, got[2].error) == (None, "no_agent") and 3 not in got


def test_written_tables_need_a_shared_folder_and_go(spark, monkeypatch):
    df = session.materialise(spark.range(3))
    assert df.count() == 3
    monkeypatch.setattr(session, "RUN", "other")
    assert session.materialise(spark.range(2)).count() == 2
    session.clean(spark)
    assert df.count() == 3

    class Cluster:
        conf = spark.conf

        class sparkContext:  # noqa: N801
            master = "spark://somewhere:7077"
            getCheckpointDir = staticmethod(lambda: None)  # noqa: N815

    monkeypatch.setattr(Cluster, "conf", type("Conf", (), {"get": staticmethod(lambda k, d=None: d)}))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Cluster)
