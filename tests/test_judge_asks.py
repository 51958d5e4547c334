"""A judge is asked each prompt once, whatever the plan, and a few at a time."""

import os

from pyspark.sql import functions as F

from textforge.operators import judge as J


def asks_into(path):
    def loader():
        client = J.stub_judge_client()

        def ask(texts):
            with open(f"{path}-{os.getpid()}", "a") as f:
                f.writelines(f"{len(texts)}\n" for _ in texts)
            return client(texts)
        return ask
    return loader


def asked(tmp, name):
    return [int(x) for p in os.listdir(tmp) if p.startswith(name) for x in open(f"{tmp}/{p}")]


def test_a_known_prompt_is_not_asked_where_nothing_is_broadcast(spark, tmp_dir):
    own = spark.newSession()
    own.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    df = own.createDataFrame([(i, f"p{i % 300}") for i in range(400)], "id long, prompt string")
    first = J.judge_with_store(df, f"{tmp_dir}/store", load_client=asks_into(f"{tmp_dir}/first")).count()
    assert first == 400 and len(asked(tmp_dir, "first")) == 300            # each prompt once
    assert J.judge_with_store(df, f"{tmp_dir}/store", load_client=asks_into(f"{tmp_dir}/again")).count() == 400
    assert not asked(tmp_dir, "again")


def test_a_judge_is_given_few_prompts_at_a_time(spark, tmp_dir):
    df = spark.range(1000, numPartitions=1).select("id", F.concat(F.lit("p"), "id").alias("prompt"))
    rows = J.batch_judge(df, load_client=asks_into(f"{tmp_dir}/calls")).collect()
    assert sorted(r.id for r in rows) == list(range(1000)) and {r.attempt for r in rows} == {1}
    assert len(asked(tmp_dir, "calls")) == 1000 and max(asked(tmp_dir, "calls")) <= J.ASK_ROWS
