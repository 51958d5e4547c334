"""Request validation cases of the API tests, response extraction, splits."""

from pyspark.sql import functions as F

from textforge.operators import corpus as C
from textforge.operators import requests as RQ

SCHEMA = ("request_id long, prompt string, max_tokens long, temperature double, "
          "repetition_penalty double, system_prompt string")


def _validate(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return {r.request_id: r for r in RQ.validate_requests(df).collect()}


def test_rejections(spark):
    rows = [(1, "", None, None, None, None), (2, "   ", None, None, None, None),
            (3, None, None, None, None, None), (4, "x" * 5000, None, None, None, None),
            (5, "ok text", None, 5.0, None, None), (6, "ok text", 0, None, None, None),
            (7, "ok text", None, None, 0.5, None), (8, "ok text", None, None, None, "s" * 501)]
    got = _validate(spark, rows)
    assert not any(r.accepted for r in got.values())
    assert "prompt_blank" in got[2].reasons and "prompt_missing" in got[3].reasons
    assert got[4].reasons == ["prompt_too_long"] and got[5].reasons == ["temperature_out_of_range"]


def test_accepted_defaults_and_warning(spark):
    got = _validate(spark, [(1, "  summarize me  ", None, 1.5, None, None)])[1]
    assert got.accepted and got.prompt == "summarize me"
    assert (got.max_tokens, got.repetition_penalty, got.system_prompt) == (150, 1.3, RQ.DEFAULTS["system_prompt"])
    assert got.high_temperature


def test_extract_and_classify(spark):
    body = '{"choices":[{"message":{"content":"  hi "}}],"usage":{"prompt_tokens":3,"completion_tokens":2,"total_tokens":5}}'
    df = spark.createDataFrame([(1, "response", 200, body), (2, "timeout", None, None), (3, "exception", 200, None),
                                (4, "response", 503, body)], "id long, outcome string, status_code int, body string")
    r = {x.id: x for x in RQ.extract_response(df).withColumn("s", RQ.classify_status()).collect()}
    assert r[1].summary == "hi" and r[1].total_tokens == r[1].prompt_tokens + r[1].completion_tokens
    assert [r[i].s for i in (1, 2, 3, 4)] == [200, 504, 500, 502]


def test_split_exact_sizes(spark):
    df = spark.range(1000).withColumnRenamed("id", "id")
    counts = {r.split: r.n for r in C.split_report(C.split_exact(df, "id")).collect()}
    assert counts == {"train": 900, "val": 50, "test": 50, "total": 1000}


def test_split_hash_stable_and_disjoint(spark):
    df = spark.range(2000)
    a = C.split_hash(df, "id").collect()
    b = C.split_hash(df.repartition(7), "id").collect()
    assert sorted(a) == sorted(b)
    counts = {r.split: r.n for r in C.split_report(C.split_hash(df, "id")).collect()}
    assert counts["train"] + counts["val"] + counts["test"] == counts["total"] == 2000
    assert 1700 < counts["train"] < 1900


def test_to_instruction_missing_column(spark):
    df = spark.createDataFrame([("a",)], "article string")
    r = C.to_instruction(df).first()
    assert (r.input, r.output) == ("a", "") and r.instruction == C.INSTRUCTION


def test_build_payload_golden(spark):
    import json
    df = spark.createDataFrame([(1, "نص", 50, 0.1, 1.3, "لخص:")], SCHEMA)
    got = json.loads(df.select(RQ.build_payload(df, stream=True).alias("p")).first().p)
    assert list(got) == ["model", "messages", "max_tokens", "temperature", "repetition_penalty", "stop", "stream"]
    assert got["messages"] == [{"role": "system", "content": "لخص:"}, {"role": "user", "content": "نص"}]
    assert got["stop"] == list(RQ.STOP) and got["stream"] is True and got["max_tokens"] == 50


def test_render_chat_and_conversations(spark):
    from textforge.operators import chat as CH
    df = spark.createDataFrame([("sys", "in", "out")], "instruction string, input string, output string")
    t = df.select(CH.render_chat(CH.build_messages("instruction", "input", "output"), False).alias("t")).first().t
    assert t.startswith("<|begin_of_text|><|start_header_id|>system<|end_header_id|>\n\nsys<|eot_id|>")
    assert t.endswith("<|start_header_id|>assistant<|end_header_id|>\n\nout<|eot_id|>")
    turns = spark.createDataFrame([(1, 1, "user", "b"), (1, 0, "system", "a")], "conv_id long, turn long, role string, text string")
    r = CH.render_conversations(turns, chunk=1).first().text
    assert r.index("\n\na<|eot_id|>") < r.index("\n\nb<|eot_id|>")


class _SplitTokenizer:
    def encode(self, text):
        return text.split()


def test_exact_tokenizer_udf_matches_native_whitespace(spark):
    from pyspark.sql import functions as F

    from textforge.operators import chat as CH
    df = spark.createDataFrame([("a  b\tc",), ("",), (None,), ("one two",)], "t string")
    udf = CH.tokenizer_count_udf(_SplitTokenizer)
    rows = df.select(udf(F.col("t")).alias("u"), CH.token_count("t").alias("n")).collect()
    assert [r.u for r in rows] == [3, 0, None, 2]
    assert [r.n for r in rows[:2]] + [rows[3].n] == [3, 0, 2]
